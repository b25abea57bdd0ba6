"""The trained operators: held-out accuracy on the smallest tables' rules, gradients, edge cases."""

import random

import numpy as np
import pytest

from paperloom.llm import common, language_id, quality, toxicity

SYLLABLES = {"en": ["the", "ing", "er", "wh", "th", "ou"], "fr": ["eau", "é", "qu", "oi", "ai", "ê"], "de": ["sch", "ung", "ü", "ein", "pf", "z"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def test_recurrent_gradients():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(0)
    hidden, steps, lanes = 3, 5, 2
    x = rng.integers(0, 256, (steps, lanes)).astype(np.uint8)
    table, inner, shift = (rng.normal(size=s).astype(np.float64) for s in ((9, 256), (9, 3), (3, 1)))
    weights = rng.normal(size=(steps, hidden, lanes))
    for backwards in (False, True):
        def loss():
            return float((language_id._forward(x, table, inner, shift, backwards)[0].astype(np.float64) * weights).sum())

        _, kept = language_id._forward(x, table, inner, shift, backwards)
        grads = language_id._backward(x, weights, kept, inner, table.shape, backwards)
        for array, grad in zip((table, inner, shift), grads):
            for _ in range(6):
                at = tuple(rng.integers(0, n) for n in array.shape)
                if array is table:
                    at = (at[0], int(x[rng.integers(0, steps), 0]))
                old = array[at]
                array[at] = old + 1e-3
                up = loss()
                array[at] = old - 1e-3
                down = loss()
                array[at] = old
                assert grad[at] == pytest.approx((up - down) / 2e-3, abs=2e-2)


def test_reader_agrees_with_training_network():
    rng = random.Random(1)
    config = language_id.Config(windows_each=3, epochs=4, window=32)
    texts, labels = zip(*[(prose(rng, lang, 40), lang) for lang in SYLLABLES for _ in range(40)])
    model = language_id.fit(list(texts), list(labels), config)
    reader = language_id.Reader(model)
    x = np.frombuffer(texts[0].encode()[:32], np.uint8)[:, None]
    ahead, _ = language_id._forward(x, model.table[0], model.inner[0], model.shift[0], False)
    back, _ = language_id._forward(x, model.table[1], model.inner[1], model.shift[1], True)
    z = model.out @ np.concatenate([ahead, back], axis=1) + model.bias
    p = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(reader.positions(x), p / p.sum(1, keepdims=True), atol=1e-4)
    fresh = [(prose(rng, lang, 30), lang) for lang in SYLLABLES for _ in range(30)]
    got = [model.labels[k] for k in reader.pooled([t for t, _ in fresh]).argmax(1)]
    assert np.mean([a == b for a, (_, b) in zip(got, fresh)]) >= 0.97
    long = prose(rng, "fr", 30_000)
    assert np.allclose(reader.pooled([long, "", long])[0], reader.pooled([long])[0]) and not reader.pooled([""]).any()


def test_language_queries_handle_edges(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, lang, 30), lang) for k, lang in enumerate(list(SYLLABLES) * 60)] + [(900, None, "en"), (901, "", None), (902, "12 34 !!", "fr"), (903, prose(rng, "de", 30), None), (None, "the thing", "en"), (0, rng.choice("ab"), "en")]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    model = language_id.train(df)
    got = language_id.identify(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 900}
    assert [by[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"] and by[900].score == 0.0
    held = [r for r in got if r.doc_id is not None and 0 < r.doc_id < 180]
    assert np.mean([r.lang_pred == list(SYLLABLES)[r.doc_id % 3] for r in held]) > 0.95
    assert {r.lang_pred for r in language_id.identify(df, language_id.train(df.limit(0))).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0


def toxic_rows(rng, n):
    words = ["w" + "".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    for k in range(n):
        text = rng.choices(words, k=rng.randint(20, 200))
        toxic = k % 4 == 0
        if toxic:
            for _ in range(max(2, len(text) // 30)):
                text.insert(rng.randrange(len(text)), rng.choice(["stupid", "worthless", "disgusting"]))
        yield k, " ".join(text), int(toxic)


def test_toxicity_generalises_to_misspellings(spark):
    rng = random.Random(3)
    rows = list(toxic_rows(rng, 600))
    docs = spark.createDataFrame([(i, t, 0.1) for i, t, _ in rows] + [(9000, None, 0.1), (9001, "", 0.1), (1, "repeated id", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9000, None), (None, 1), (12345, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect() if r.doc_id != 1}
    from zlib import crc32

    held = [(got[i], y) for i, _, y in rows if i != 1 and crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.97
    assert 0 <= got[9000] == got[9001] < 0.5
    score = toxicity.scorer(model)
    clean = rows[1][1]
    assert score(clean + " stupiid worthles disgustingg" * 4) > 0.5 > score(clean)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {9000, 9001}
    assert toxicity.reject(docs.limit(0), model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert max(r.score for r in toxicity.score_documents(docs, none).collect()) < 0.01


def test_quality_separates_and_is_calibrated(spark):
    rng = random.Random(4)
    rows = []
    for k in range(500):
        words = ["".join(rng.choices("aeioutrs", k=rng.randint(2, 8))) for _ in range(rng.randint(10, 80))]
        good = k % 3 != 0
        rows.append((k, " ".join(words) if good else " ".join(w.upper() + "!!" if rng.random() < 0.7 else w for w in words), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    from zlib import crc32

    held = [(got[i], y) for i, _, y in rows if crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.97
    assert abs(np.mean([s for s, _ in held]) - np.mean([y for _, y in held])) < 0.06
    assert got[9000] == got[9001] and 0 <= got[9000] <= 1
    assert quality.score_documents(docs.limit(0), model).count() == 0


def test_samples_are_bounded_and_leave_the_fold_out(spark):
    from zlib import crc32

    rows = spark.createDataFrame([(i, i % 3) for i in range(3000)], "doc_id long, k int")
    docs = rows.selectExpr("doc_id", "concat('t', doc_id) text")
    texts, labels, freq = common.labelled_texts(docs, rows, "k", "doc_id", "text", 5, 0, 100)
    assert len(texts) == 300 and sum(freq.values()) == sum(crc32(str(i).encode()) % 5 != 0 for i in range(3000))
    assert np.bincount(labels).tolist() == [100, 100, 100] and all(crc32(t[1:].encode()) % 5 for t in texts)
    again = common.labelled_texts(docs.repartition(7), rows.repartition(5), "k", "doc_id", "text", 5, 0, 100)
    assert again[0] == texts and again[1].tolist() == labels.tolist()
    few, which, _ = common.labelled_texts(docs, rows, "k", "doc_id", "text", 5, 0, 100, most_chars=300)
    assert sum(map(len, few)) <= 300 and len(few) >= 45 and set(few) <= set(texts) and np.ptp(np.bincount(which)) == 0


def test_more_languages_than_any_bound_and_no_letters(spark):
    rng = random.Random(4)
    rows, languages = [], ["l%02d" % k for k in range(70)]
    for k, lang in enumerate(languages):
        own = "".join(chr(0x4E00 + 40 * k + j) for j in range(12))  # each has its own letters
        rows += [(100 * k + j, " ".join("".join(rng.choices(own, k=4)) for _ in range(12)), lang) for j in range(12)]
    rows += [(9000, "² ½ Ⅷ 123 ...", None), (9001, None, "l00"), (9002, "", None), (9003, rows[0][1], None), (9003, rows[0][1], None)]
    docs = spark.createDataFrame([(*r, 0.1, 1) for r in rows], "doc_id long, text string, lang string, score double, rank int")
    model = language_id.train(docs, config=language_id.Config(hidden=24, epochs=16, windows_each=4, window=48))
    assert list(model.labels) == languages
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0.0 for k in (9000, 9001, 9002))
    twice = [r for r in got if r.doc_id == 9003]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert np.mean([by[i].lang_pred == lang for i, _, lang in rows[:840]]) > 0.9
    assert language_id.train(docs.filter("lang is null")) is None


def test_a_document_is_the_mean_of_its_letters_positions():
    """The pooled result by plain loops: every state by the network's equations, one position after the other."""
    rng = random.Random(2)
    config = language_id.Config(windows_each=2, epochs=2, window=24, hidden=3)
    model = language_id.fit(*zip(*[(prose(rng, lang, 20), lang) for lang in SYLLABLES for _ in range(6)]), config)
    text = "Été, 12 thing!  " + prose(rng, "de", 9)
    raw, total, n = text.encode(), np.zeros(3), 0
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for at in range(0, len(raw), config.window):
        lane = raw[at:at + config.window]
        padded, states = lane.ljust(config.window, b"\0"), [[], []]
        for k, order in ((0, range(config.window)), (1, range(config.window - 1, -1, -1))):
            h = np.zeros(3)
            for t in order:
                a, b = model.table[k][:, padded[t]], model.inner[k] @ h
                z, r = sigmoid(a[:3] + b[:3]), sigmoid(a[3:6] + b[3:6])
                h = (1 - z) * np.tanh(a[6:] + r * (b[6:] + model.shift[k][:, 0])) + z * h
                states[k].append(h)
        states[1].reverse()
        for t, c in enumerate(lane):
            if c >= 128 or chr(c).isalpha():
                e = np.exp(model.out @ np.concatenate([states[0][t], states[1][t]]) + model.bias[:, 0])
                total += e / e.sum()
                n += 1
    assert np.allclose(language_id.Reader(model).pooled([text])[0], total / n, atol=1e-4)


def test_toxicity_score_by_plain_loops():
    rng = random.Random(6)
    good, bad = [prose(rng, "en", 30) for _ in range(60)], [prose(rng, "en", 20) + " stupid idiot " + prose(rng, "en", 8) for _ in range(60)]
    model = toxicity.fit(good + bad, np.array([0] * 60 + [1] * 60), {0: 60, 1: 60}, toxicity.Config(buckets=1 << 12))
    for text in (bad[0], good[0], "", "¡!", "stupiid", "a" * 50_000, ("idiot " * 50_000)):
        words = toxicity.WORD.findall(text.lower())
        read = [np.mean([model.cells[k] for k in toxicity.subwords(w, 1 << 12, 3, 6)]) for w in words]
        z = model.bias + (np.mean(read) if words else 0)
        assert toxicity.scorer(model)(text) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
    assert toxicity.subwords("ab", 1 << 12, 3, 6) == [crc(x) % 4096 for x in ("<ab>", "<ab", "ab>", "<ab>")]


def crc(x):
    from zlib import crc32

    return crc32(x.encode("utf-16-le"))


def test_quality_features_by_plain_loops():
    rng = random.Random(7)
    texts = [prose(rng, "fr", rng.randint(0, 40)) for _ in range(30)]
    config = quality.Config(dim=8, index_rows=64)
    index = quality.index_vectors(config)
    assert all((row != 0).sum() == config.signs and abs(np.linalg.norm(row) - 1) < 1e-6 for row in index)
    vocabulary, vectors = quality.word_vectors(texts, index, config)
    own = lambda w: index[crc8(w) % 64]
    plain = {}
    for t in texts:
        words = quality.TOKEN.findall(t)
        for i, w in enumerate(words):
            for j in range(max(0, i - config.reach), min(len(words), i + config.reach + 1)):
                if j != i:
                    plain[w] = plain.get(w, 0) + own(words[j])
    for w, k in vocabulary.items():
        assert np.allclose(vectors[k], plain[w] / max(1e-9, np.linalg.norm(plain[w])), atol=1e-4)
    pool, text = quality.Pooler(vocabulary, vectors, index), texts[3] + " xyzzy 12 !!!"
    words = quality.TOKEN.findall(text)
    each = np.stack([vectors[vocabulary[w]] if w in vocabulary else vectors[len(vocabulary) + quality.shape(w)] for w in words])
    f = pool(text)
    assert np.allclose(f[:8], each.mean(0), atol=1e-5) and np.allclose(f[8:16], (each ** 2).mean(0), atol=1e-5)
    assert f[-3] == pytest.approx(np.linalg.norm(np.mean([own(w) for w in words], axis=0)), abs=1e-5)
    assert not pool("").any()


def crc8(w):
    from zlib import crc32

    return crc32(w.encode())


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_one_class_no_labels_long_and_repeated_rows(spark, module):
    rng = random.Random(9)
    rows = [(k, prose(rng, "en", 30) + (" stupid idiot" if k % 2 else "")) for k in range(120)] + [(500, None), (501, ""), (502, "the idiot " * 60_000), (1, "again"), (1, "again")]
    docs = spark.createDataFrame([(*r, 0.25, "x", "y") for r in rows], "doc_id long, text string, score double, label string, place string")
    label = "quality" if module is quality else "toxic"
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(120)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.filter("toxic = 1"), labels.filter("toxic = 0"), labels.limit(0), labels.withColumns({"quality": labels.quality * None, "toxic": labels.toxic * None})):
        model = module.train(docs, some.select("doc_id", "quality", "toxic"), label_col=label)
        got = module.score_documents(docs, model)
        assert sorted(got.columns) == sorted(docs.columns)
        found = got.collect()
        assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
        assert len({r.score for r in found if r.text == "again"}) == 1
    assert module.score_documents(docs.limit(0), model).count() == 0
