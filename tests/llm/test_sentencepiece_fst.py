import random
import struct
from pathlib import Path

import pytest

from paperloom.llm import sentencepiece_fst as S
from paperloom.llm.queries import PIECE_MODEL, TOKENIZERS

MODEL = Path(TOKENIZERS, PIECE_MODEL)


@pytest.fixture(scope="module")
def pair():
    sentencepiece = pytest.importorskip("sentencepiece")
    data = MODEL.read_bytes()
    return S.Transducer(data), sentencepiece.SentencePieceProcessor(model_proto=data)


def texts(n):
    rng = random.Random(7)
    words = ["the", "thing", "nation", "étrange", "naïve", "Schifffahrt", "ñandú", "漢字", "1234", "a.b,c!!", "***", "😀", "نص", "x"]
    for _ in range(n):
        yield "".join(rng.choice([*words, " ", " ", "  ", "\n", "\t", "▁", rng.choice("abcdefghij"), "İ̇"]) for _ in range(rng.randint(0, 30)))


def test_ids_equal_those_of_the_library(pair):
    own, library = pair
    for t in [*texts(1500), "", " ", "a" * 5000, "the " * 4000, "!?" * 3000, " " * 300]:
        ids = own.encode(t)
        assert ids.tolist() == library.encode(t)
        assert own.decode(ids) == t.replace("▁", " ")  # the mark itself reads as the space that it stands for


def test_merging_is_the_one_path_that_the_grammar_leaves(pair):
    own, library = pair
    for t in ("unbelievable", "thththation", "aaaaaaa"):
        pieces = [own.model.pieces[k] for k in own.shortest("▁" + t)]
        assert pieces == own.grammar.merge("▁" + t) == library.encode(t, out_type=str)


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += bytes([number << 3 | 2]) + bytes([len(value)]) + value
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += bytes([number << 3, value])
    return out


def unigram(pieces, **spec):
    rows = [message((1, message((1, p.encode()), (2, s), (3, t)))) for p, s, t in pieces]
    return b"".join(rows) + message((2, message((3, 1))), (3, message((3, 1), (4, spec.get("squeeze", 0)))))


def test_scored_model_takes_the_path_of_least_weight():
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -3.5, 1), ("▁a", -2.5, 1), ("▁ab", -9.0, 1), ("ba", -4.0, 1)]
    m = S.Transducer(unigram(pieces))

    def brute(s):
        if not s:
            return 0.0, []
        best = None
        for n in range(1, len(s) + 1):
            k = m.ids.get(s[:n])
            if k is None and n > 1:
                continue
            w, rest = brute(s[n:])
            w += m.pieces.fallback if k is None else -m.model.scores[k]
            if best is None or w < best[0] - 1e-9:
                best = (w, [s[:n], *rest])
        return best

    for t in ("ab", "aab", "abab", "b", "ba", "azb", "abba"):
        path = m.shortest("▁" + t)
        cost = sum(m.pieces.fallback if k >= S.LETTER else -m.model.scores[k] for k in path)
        assert cost == pytest.approx(brute("▁" + t)[0]) and "".join(m.model.pieces[k] if k < S.LETTER else chr(k - S.LETTER) for k in path) == "▁" + t
    assert m.encode("z").tolist() == [1, 0]
    assert S.Transducer(unigram(pieces, squeeze=1)).encode("  a   b ").tolist() == m.encode("a b").tolist()


def double_array(rules):
    """A character map in the model format: cells found by first fit, then the outputs."""
    outputs, places = b"", {}
    for k, v in sorted(rules.items()):
        places[k.encode()] = len(outputs)
        outputs += v.encode() + b"\0"
    cells, used = {0: 0}, {0}

    def grow(prefix, node):
        labels = sorted({k[len(prefix)] for k in places if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in places
        # an offset is written in ten bits or more, its base is node ^ offset
        base = next(b for b in range(1, 4000) if (b ^ node) < 1 << 20 and all((b ^ c) not in used for c in labels) and (not leaf or b not in used))
        cells[node] |= (base ^ node) << 10 | (256 if leaf else 0)
        used.update([b for b in [base] if leaf] + [base ^ c for c in labels])
        if leaf:
            cells[base] = places[prefix] | 1 << 31
        for c in labels:
            cells[base ^ c] = c
        for c in labels:
            grow(prefix + bytes([c]), base ^ c)

    grow(b"", 0)
    size = -(-(max(cells) + 1) // 256) * 256
    return struct.pack("<I", 4 * size) + struct.pack(f"<{size}I", *(cells.get(i, 0) for i in range(size))) + outputs


def varint(n):
    return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])


@pytest.mark.parametrize("squeeze", [0, 1])
def test_character_maps_read_as_in_the_library(squeeze):
    sentencepiece = pytest.importorskip("sentencepiece")
    data = MODEL.read_bytes()
    rules = {"Ａ": "A", "ﬁ": "fi", "\t": " ", "é": "e", "ab": "X", "abc": "the", "½": "1/2", "\u200b": ""}
    spec = message((3, 1), (4, squeeze), (5, 1))
    table = double_array(rules)
    spec = b"\x12" + varint(len(table)) + table + spec
    model = data + b"\x1a" + varint(len(spec)) + spec  # a field that comes twice is merged, the later one counts
    own, library = S.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice([*rules, "abd", "a", " ", "  ", "nation", "ﬁn", "漢", "😀"]) for _ in range(rng.randint(0, 12)))
        assert own.encode(t).tolist() == library.encode(t), t


def test_composition_by_hand():
    """Weights of every path through a stretch, added up by hand, against the one that is taken."""
    m = S.Transducer(unigram([("<unk>", 0.0, 2), ("▁", -1.0, 1), ("a", -2.0, 1), ("aa", -3.5, 1), ("▁a", -4.0, 1)]))
    # ▁|a|a 1+2+2=5, ▁|aa 1+3.5=4.5, ▁a|a 4+2=6
    assert [m.model.pieces[k] for k in m.shortest("▁aa")] == ["▁", "aa"]
    # a letter without a piece: the greatest weight (4) and 10 more
    assert m.pieces.fallback == 14.0 and m.shortest("▁z") == [1, S.LETTER + ord("z")]
    assert m.encode("zz z").tolist() == [1, 0, 1, 0]


def test_memos_are_bounded(pair):
    m = S.Transducer(MODEL.read_bytes(), room=100_000)
    rng = random.Random(5)
    t = " ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(5000))
    assert m.encode(t).tolist() == pair[1].encode(t)
    assert m.paths.took <= 50_000 and m.grammar.arcs.took <= 50_000 and len(m.paths) + len(m.paths.older) < 1000


def test_documents(spark):
    rows = [(1, "the nation"), (2, None), (3, ""), (4, "a" * 3000), (4, "x\ny")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, round_trip int")
    data = MODEL.read_bytes()
    out = S.encode(df, data)
    assert out.columns == ["doc_id", "text", "piece_ids", "round_trip"]
    back = S.decode(out, data).collect()
    assert len(back) == 5 and all(r.decoded == r.text for r in back)
    by = {(r.doc_id, r.text): r for r in back}
    assert by[2, None].piece_ids is None and by[2, None].round_trip is None and by[3, ""].piece_ids == [] and by[3, ""].round_trip
    assert S.encode(df.limit(0), data).count() == 0
