"""Line dedup, fingerprints, substring dedup and decontamination against plain Python."""

import hashlib
import random
import re

import pytest

from paperloom.llm import decontaminate, fingerprints, line_dedup, substring_dedup

DOC = "doc_id long, text string, score double, pos int, h1 long, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, 2, "x") for i, t in rows], DOC)


def plain_line_dedup(rows, least=10, min_docs=2):
    blank = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(blank).translate(low)
    holders = {}
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [i is not None and len(key(x)) >= least and len(holders[key(x)]) >= min_docs and min(holders[key(x)]) != i for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


LINE_ROWS = [
    (1, "The same old line\nonly here at one"), (2, "  the SAME old line\t\nshort\nshort\n"), (3, None), (4, ""), (5, "short\nThe same old line\nThe same old line"),
    (6, "ÀÉÎ long enough line\nx"), (7, "àéî long enough line"), (8, "ÀÉÎ long enough line "), (9, "\n\n\n"), (9, "\n\nThe same old line"),
    (None, "The same old line"), (10, "a" * 5000 + "\n" + "nine char"), (11, "a" * 5000), (12, "nine char"),
]


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup(spark, min_docs):
    got = line_dedup.dedup_lines(frame(spark, LINE_ROWS), min_docs=min_docs)
    assert got.columns == ["doc_id", "text", "score", "pos", "h1", "id", "n_lines", "n_dropped"]
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=str)
    assert found == plain_line_dedup(LINE_ROWS, min_docs=min_docs)


def test_line_dedup_keeps_nulls_and_takes_empty_tables(spark):
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, LINE_ROWS)).collect()}
    assert got[3] is None and got[4] == ""
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def plain_shingles(text, n=5):
    words = text.lower().split()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def edits(rows):
    rows = sorted((i, t or "") for i, t in rows if i is not None)
    for k, (i, t) in enumerate(rows):
        n = len(t) // 4
        yield i, t, t[:len(t) - n] + rows[(k + 1) % len(rows)][1][:n], rows[(k + 1) % len(rows)][1]


def test_fingerprints_of_edited_texts(spark):
    rng = random.Random(3)
    words = ["w%d" % k for k in range(400)]
    rows = [(k * 7, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 40, 2500])))) for k in range(40)]
    rows += [(1000, rows[4][1]), (1001, rows[4][1]), (1002, None), (1003, "é" * 50), (None, "no id")]
    config = fingerprints.Config(one_in=2)
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(frame(spark, rows), config=config).collect()}
    assert len(got) == len(rows) - 1
    for i, text, edited, after in edits(rows):
        r = got[i]
        assert r.edited == edited and r.n_chars == len(text)
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = plain_shingles(text), plain_shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert 0 <= near <= 1
            if len(a | b) > 500:
                assert abs(near - true) < 0.12
            if text == other:
                assert near == 1.0
    assert got[1000].fingerprint == got[1001].fingerprint and got[1000].near_next == 1.0


def test_fingerprints_of_short_texts_are_compared_whole(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(rng.choice([0, 1, 2, 4, 6, 12, 40])))) for k in range(60)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(frame(spark, rows)).collect()}
    for i, text, edited, after in edits(rows):
        a, r = plain_shingles(text), got[i]
        for near, b in ((r.near_edited, plain_shingles(edited)), (r.near_next, plain_shingles(after))):
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-9
        b = plain_shingles(edited)
        assert abs(r.contained_edited - (len(a & b) / len(a) if a else 1.0)) < 1e-9


def test_fingerprint_keeps_each_hash_below_the_fraction(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"word{k}" for k in range(300))
    df = spark.createDataFrame([(text, text + " and some words more than there were"), (None, "")], "a string, b string")
    c = fingerprints.Config(one_in=4)
    r = df.select(fingerprints.sketch(F.coalesce("a", F.lit("")), fingerprints.Config(one_in=1)).alias("all"), fingerprints.sketch(F.coalesce("a", F.lit("")), c).alias("some"),
                  fingerprints.containment(fingerprints.sketch(F.col("a"), c), fingerprints.sketch(F.col("b"), c)).alias("inside")).collect()
    assert len(r[0]["all"]) == 296
    assert r[0]["some"] == [h for h in r[0]["all"] if h <= -(1 << 63) + (1 << 62)]
    assert r[0]["inside"] == 1.0 and r[1]["some"] == []


def test_next_document_over_many_ranges(spark):
    ids = spark.createDataFrame([(i * i, i) for i in range(200)], "id long, size int")
    got = sorted(map(tuple, fingerprints.with_next(ids, "id", "size").collect()))
    assert got == [(i * i, ((i + 1) % 200) ** 2, (i - 1) % 200) for i in range(200)]
    assert fingerprints.with_next(ids.limit(1), "id", "size").count() == 1
    assert fingerprints.with_next(ids.limit(0), "id", "size").count() == 0


def plain_substring_dedup(rows, least=15):
    """By definition, from the text alone: runs are tuples of sentences' words, compared one by one."""
    docs = {}
    for i, t in rows:
        pieces = [x for x in re.split(r"((?<=[.!?])\s+|\s*\n\s*)", t or "")]
        docs[i] = [(p.split(), p, pieces[k + 1] if k + 1 < len(pieces) else "") for k, p in enumerate(pieces) if k % 2 == 0 and p.strip()]
    places = {}
    for i, parts in docs.items():
        n = len(parts)
        size = lambda a, b: sum(len(parts[k][0]) for k in range(a, b))
        spans = set()
        for k in range(n):
            spans.add((k, next((e for e in range(k + 1, n + 1) if size(k, e) >= least), None)))
            spans.add((next((f for f in range(k, -1, -1) if size(f, k + 1) >= least), None), k + 1))
        for f, e in spans:
            if f is not None and e is not None:
                places.setdefault(tuple(tuple(parts[k][0]) for k in range(f, e)), []).append((i, f, e))
    gone = {i: set() for i in docs}
    for where in places.values():
        for i, f, e in sorted(where)[1:]:
            gone[i].update(range(f, e))
    return {i: "".join(p + g for k, (_, p, g) in enumerate(parts) if k not in gone[i]) for i, parts in docs.items()}


def test_substring_dedup(spark):
    rng = random.Random(5)
    sentence = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps"] + ["w%d" % k for k in range(90)], k=rng.randint(3, 14))) + rng.choice(".!?")
    passages = [[sentence() for _ in range(8)] for _ in range(3)]
    rows = []
    for k in range(60):
        parts = [sentence() for _ in range(rng.randint(0, 6))]
        if k % 3 == 0:
            parts += passages[k % 2] + [sentence() for _ in range(3)]
        rows.append((k, rng.choice([" ", "\n"]).join(parts)))
    rows += [(100, None), (101, ""), (102, rows[0][1] + " " + rows[0][1])]
    got = {r.doc_id: r.text for r in substring_dedup.dedup_substrings(frame(spark, rows)).collect()}
    want = plain_substring_dedup(rows)
    assert {i: t or "" for i, t in got.items()} == want
    assert got[100] is None and sum(passages[0][3] in (t or "") for t in got.values()) == 1
    assert substring_dedup.dedup_substrings(frame(spark, [])).count() == 0


def test_substring_dedup_leaves_clean_texts_alone(spark):
    rows = [(k, f"Text {k} says one thing. It has a second sentence of number {k}.\n\nAnd  a third, {k} too.") for k in range(30)]
    got = substring_dedup.dedup_substrings(frame(spark, rows)).collect()
    assert {(r.doc_id, r.text) for r in got} == set(rows) and not any(r.n_sentences_dropped for r in got)


def numbered(tag, *sizes):
    return [" ".join(f"{tag}{k}x{j}" for j in range(n)) + "." for k, n in enumerate(sizes)]


def test_substring_dedup_finds_short_whole_sentences_of_a_passage(spark):
    # the passage's first and last sentences run into each host's text: 16 words in two sentences are whole
    rows = [(k, " ".join([f"host{k}", *numbered("p", 20, 9, 7), "end", f"of{k} host."])) for k in range(2)]
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(frame(spark, rows)).collect()}
    assert got[0].text == rows[0][1] and got[1].n_sentences_dropped == 2 and "p1x0" not in got[1].text and "p0x5" in got[1].text


def test_substring_dedup_takes_a_passage_to_its_last_sentence(spark):
    for sizes in ((35, 2, 1, 13, 9, 1), (25, 3, 4, 2), (9, 9, 9)):
        passage = " ".join(numbered("q", *sizes))
        rows = [(k, f"Of document {k} alone.\n{passage}\nEnd number {k}.") for k in range(3)]
        got = {r.doc_id: r for r in substring_dedup.dedup_substrings(frame(spark, rows)).collect()}
        assert got[0].text == rows[0][1] and all(got[k].n_sentences_dropped == len(sizes) and "q" not in got[k].text for k in (1, 2))


def test_long_texts_take_linear_time(spark):
    import time

    def took(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    assert took(lambda: substring_dedup.sentences("a." + " " * 100_000 + "b" + "\n" * 100_000 + " c")) < 1
    assert took(lambda: decontaminate.token_hash("a" + "=" * 100_000 + "b" + "_" * 100_000)) < 1
    text = "\n".join(f"line number {k % 5000} of a text" for k in range(100_000))
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, [(1, text), (2, text + "\nlast")])).collect()}
    assert time.time() - began < 20
    assert got[1].text == text and got[2].text == "last" and got[2].n_lines == 100_001 and got[2].n_dropped == 100_000


def test_sketches_of_short_texts_are_not_empty(spark):
    from pyspark.sql import functions as F

    rows = [("completely different words here",), ("one",), ("other",), ("",), ("ONE",)]
    df = spark.createDataFrame(rows, "text string")
    c = fingerprints.Config(one_in=1 << 20)
    got = [r[0] for r in df.select(fingerprints.sketch(F.col("text"), c)).collect()]
    assert [len(x) for x in got] == [1, 1, 1, 0, 1] and got[1] == got[4] != got[2]
    names = [r[0] for r in df.select(fingerprints.written(fingerprints.sketch(F.col("text"), c))).collect()]
    assert all(re.fullmatch("([0-9a-f]{16})*", x) for x in names) and names[3] == "" and len(set(names)) == 4
    both = df.select(fingerprints.merge(F.array(F.lit(5), F.lit(-9)), F.array(F.lit(3)), fingerprints.Config(one_in=2))).first()[0]
    assert both == [-9]
    near = [(1, "completely different words here"), (2, ""), (3, "a b")]
    found = {r.doc_id: r for r in fingerprints.fingerprint_edits(frame(spark, near)).collect()}
    assert [found[k].near_next for k in (1, 2, 3)] == [0.0, 0.0, 0.0]


def test_contract_columns(spark):
    """Names and types that the contracts state."""
    from paperloom.llm import queries

    folder = "/root/testdata/sf0.001"
    want = {"op3_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
            "op5_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
            "op6_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
            "op7_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
            "op8_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
            "op9_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
            "op10_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}}
    for name, columns in want.items():
        assert columns.items() <= dict(queries.queries()[name](spark, folder).dtypes).items(), name


def plain_matches(text, item, share=0.8, overlap=13, miss=3.0):
    """Whether any way of laying the item along the text gives a match, by trying all."""
    strip = lambda w: re.sub(r"^[\W_]+|[\W_]+$", "", w)
    a, b = ([x for x in map(strip, s.lower().split()) if x] for s in (text, item))
    for offset in range(-len(b) + 1, len(a)):
        first, last = max(0, -offset), min(len(b), len(a) - offset)
        equal = [b[k] == a[offset + k] for k in range(first, last)]
        if equal and sum(equal) >= share * len(b):
            return True
        best = (0.0, 0, 0)
        for i in range(len(equal)):
            worth = 0.0
            for j in range(i, len(equal)):
                worth += 1.0 if equal[j] else -miss
                best = max(best, (worth, i, j + 1))
        run = equal[best[1]:best[2]]
        if run and len(run) >= (overlap if len(b) >= overlap else share * len(b)) and sum(run) >= share * len(run):
            return True
    return False


def test_decontamination_against_all_placements(spark):
    """Items of 1 to 24 tokens with substitutions anywhere; up to two (one under ten tokens) must all be found, and nothing else is."""
    rng = random.Random(19)
    words = ["tok%d" % k for k in range(400)]
    items = [(k, " ".join(rng.choices(words, k=k % 24 + 1))) for k in range(72)]
    rows, must = [], set()
    for k in range(400):
        item, text = rng.randrange(72), rng.choices(words, k=rng.randint(0, 60))
        piece = items[item][1].split()
        n = rng.choice([0, 0, 1, 2, 3])
        for p in rng.sample(range(len(piece)), min(n, len(piece))):
            piece[p] = "other"
        if len(piece) > 5 and n <= (1 if len(piece) < 10 else 2) or n == 0:
            must.add((k, item))
        at = rng.randint(0, len(text))
        text[at:at] = piece
        rows.append((k, " ".join(text)))
    found = {(r.id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    true = {(i, j) for i, t in rows for j, x in items if plain_matches(t, x)}
    assert found <= true and must <= found | {m for m in must if m not in true} and len(true - found) <= 0.02 * len(true)


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(9)
    words = ["tok%d" % k for k in range(3000)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([15, 20, 40])))) for k in range(30)] + [(30, "five tokens of an item"), (31, None), (32, "")]
    rows, want = [], set()
    for k in range(120):
        text = rng.choices(words, k=rng.randint(0, 300))
        if k % 4 == 0:
            item = rng.randrange(31)
            piece = items[item][1].split()
            if len(piece) >= 15:
                for p in range(7, len(piece), 9):
                    piece[p] = "changed"
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() + rng.choice(["", ",", "."]) for w in piece]
            want.add((k, item))
        rows.append((k, " ".join(text)))
    rows += [(500, None), (501, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    got = {(r.id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want
    small = decontaminate.Config(block_chars=600)  # more than a block: by joins
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench, config=small).collect())) == sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    assert {(r.id, r.item_id) for r in decontaminate.contaminated(docs, bench, config=small).collect()} == want
    kept = decontaminate.clean(docs, bench, config=small)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_contract_digests(spark):
    rows = [(1, "A line that repeats\nB"), (2, "a LINE that repeats \nC")]
    from pyspark.sql import functions as F

    got = line_dedup.dedup_lines(frame(spark, rows)).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {1: hashlib.sha256(rows[0][1].encode()).hexdigest(), 2: hashlib.sha256(b"C").hexdigest()}
    assert re.fullmatch("[0-9a-f]{64}", got[0].s)
