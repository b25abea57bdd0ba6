"""SentencePiece encoding and decoding with weighted finite-state transducers.

Machines are compiled from a model file; each has numbered states and arcs
(state, letter) -> (output, weight, next state).

``Normaliser``: reads the text's letters and writes normalised ones.  Its states
say whether a space may still be written; its arcs write the word mark for a
space, copy other letters, and, for a model with a character map, walk the map
and write what the longest match stands for.

``Pieces``: a trie with an arc for each letter of each piece; where a piece ends
an arc without a letter leads back to the start, writes the piece's id and
weighs its negative score.  A letter that is no piece has a byte-fallback arc,
which writes the pieces of its UTF-8 bytes (or the unknown id) and weighs more
than any piece.

``Free`` and ``Merges``: what may follow what, over piece ids.  ``Free`` has one
state.  For a model of merges ("BPE") scores are ranks of merges and do not say
on their own which path is right: the states of ``Merges`` are pieces, and it
has an arc from a to b only if merging the letters of a and b together ends in
just a, b.  (No merge crosses the bounds of the pieces that merging ends in, so
within two neighbours the merges are those of the two alone, in the same order:
the path that merging makes is always there.)  Arcs are decided when first asked
for and kept.

``shortest`` composes a stretch of text with all of them, lazily, state by state
from the left, and takes the path of least weight: the tropical semiring, in
which weights add along a path and the least wins.  Of equal ones the path of
the longer last piece wins.

No path crosses a boundary between two letters that never stand together in any
piece, so a text is cut there before composing, and the path of each distinct
stretch is kept, in memos of bounded bytes.  A model with a character map is
normalised as a whole first, as the map may reach over such a boundary.

A null text encodes to null, an empty one to no ids.  Decoding is exact: it
returns the text that was encoded, as long as the normaliser is the identity
(it is without a character map and squeezing, but for the word mark itself,
which reads as a space), with ill-formed bytes replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of the model format
UNIGRAM, MERGES = 1, 2  # fixed values: model types of the model format
UNKNOWN_PENALTY = 10.0


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = data[at]
        at += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in protocol-buffer wire format."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    """What the transducers are compiled from."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    prefix: bool = True  #: whether the normaliser puts a word mark before the text
    squeeze: bool = True  #: whether it takes spaces at the ends, and repeated ones, away
    map: bytes = b""  #: the character map: a double array over UTF-8 bytes and what its leaves stand for


def load(data: bytes) -> Model:
    """Reads a model file's bytes."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(_fields(value))
            m.pieces.append(piece[1].decode())
            m.scores.append(struct.unpack("<f", piece[2])[0])
            m.types.append(piece[3])
        elif number == 2:
            m.kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            spec = dict(_fields(value))
            m.prefix, m.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
            m.map = spec.get(2, b"")
    if m.kind not in (UNIGRAM, MERGES):
        raise ValueError(f"model type {m.kind} is not supported")
    return m


class CharacterMap:
    """Arcs over UTF-8 bytes, as the file has them: a double array of 32-bit cells, then the outputs.

    Fixed values: bit 8 of a cell says that a leaf hangs there, bits 0 to 7 and 31
    are its label, bits 10 on the offset (bit 9: in steps of 256); a leaf's cell is
    the place of its output, which ends in a zero byte.
    """

    def __init__(self, data: bytes):
        size = struct.unpack_from("<I", data)[0]
        self.cells, self.outputs = np.frombuffer(data, "<u4", size // 4, 4).tolist(), data[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, str] | None:
        """(end, output) of the longest path from ``at``."""
        cells, found = self.cells, None
        node = self._offset(cells[0])
        for i in range(at, len(text)):
            c = text[i]
            node ^= c
            if node >= len(cells) or cells[node] & 0x800000FF != c:
                break
            cell = cells[node]
            node ^= self._offset(cell)
            if cell >> 8 & 1:
                start = cells[node] & 0x7FFFFFFF
                found = i + 1, self.outputs[start:self.outputs.index(b"\0", start)].decode("utf-8", "replace")
        return found

    @staticmethod
    def _offset(cell: int) -> int:
        return (cell >> 10) << ((cell & 512) >> 6)


class Normaliser:
    """Letters to normalised letters.  States: at the start, behind a space not yet written, behind a letter."""

    START, GAP, WORD = range(3)

    def __init__(self, model: Model):
        self.prefix, self.squeeze = model.prefix, model.squeeze
        self.map = CharacterMap(model.map) if model.map else None

    def arc(self, state: int, letter: str) -> tuple[str, int]:
        """(output, next state)."""
        if letter == " ":
            if not self.squeeze:
                return MARK, self.WORD
            return "", self.START if state == self.START else self.GAP
        return (MARK if state == self.GAP else "") + letter, self.WORD

    def run(self, letters: str, state: int | None = None) -> str:
        """What the machine writes for letters that no character map touches; spaces left at the end are not written."""
        state, out = self.START if state is None else state, []
        for c in letters:
            piece, state = self.arc(state, c)
            out.append(piece)
        return "".join(out)

    def mapped(self, text: str) -> str:
        """The text under the character map: at each place the longest match, else the letter."""
        if not self.map:
            return text
        raw, at, out = text.encode("utf-8", "replace"), 0, []
        while at < len(raw):
            found = self.map.longest(raw, at)
            if found is None:
                c = raw[at]
                found = at + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4), None
            out.append(raw[at:found[0]].decode("utf-8", "replace") if found[1] is None else found[1])
            at = found[0]
        return "".join(out)


LETTER = 1 << 21  #: an id from here on is a letter without a piece


class Pieces:
    """The trie of pieces, read from their last letters on, its final weights, and the byte-fallback arc.

    Composition asks for the pieces that end at a place, so the trie starts there.
    """

    def __init__(self, model: Model):
        self.arcs: dict[int, int] = {}  #: state << 21 | letter -> state
        self.final: list[int] = [-1]  #: the id that a state's arc back to the start writes, -1 for none
        for k, (piece, kind) in enumerate(zip(model.pieces, model.types, strict=True)):
            if kind in (NORMAL, DEFINED):
                state = 0
                for c in map(ord, reversed(piece)):
                    state = self.arcs.setdefault(state << 21 | c, len(self.final))
                    if state == len(self.final):
                        self.final.append(-1)
                self.final[state] = k
        self.weights = [-x for x in model.scores]
        self.fallback = max((self.weights[k] for k in self.final if k >= 0), default=0.0) + UNKNOWN_PENALTY

    def weight(self, piece: int) -> float:
        return self.weights[piece] if piece < LETTER else self.fallback


class Free:
    """Any piece may follow any other."""

    start = 0
    only = False

    def follow(self, state: int, piece: int) -> int:
        return 0


class Merges:
    """Piece b may follow piece a if merging the letters of both ends in a, b."""

    start = 1 << 22  #: no piece yet
    only = True  #: one path at most leads to a place: the one that merging the letters up to there ends in

    def __init__(self, model: Model, room: int):
        self.pieces, self.scores = model.pieces, model.scores
        self.ids = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t in (NORMAL, DEFINED)}
        self.arcs = common.Memo(self._arc, room)

    def merge(self, letters: str) -> list[str]:
        """What merging makes of a few letters: again and again the best-scored neighbouring pair, the left one of equals."""
        parts, scores = list(letters), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _letters(self, piece: int) -> str:
        return "" if piece == self.start else self.pieces[piece] if piece < LETTER else chr(piece - LETTER)

    def _arc(self, key: int) -> bool:
        """Whether there is an arc; the key is state << 22 | piece."""
        pair = [x for x in (self._letters(key >> 22), self._letters(key & (1 << 22) - 1)) if x]
        return self.merge("".join(pair)) == pair


class Transducer:
    """The compiled machines of one model.  ``room``: bytes that each of its two memos may take."""

    def __init__(self, data: bytes, room: int = 64 << 20):
        m = self.model = load(data)
        self.normaliser, self.pieces = Normaliser(m), Pieces(m)
        self.grammar = Merges(m, room) if m.kind == MERGES else Free()
        self.ids = {p: i for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t in (NORMAL, DEFINED)}
        self.bytes_ = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t == BYTE}
        self.unknown = next((i for i, t in enumerate(m.types) if t == UNKNOWN), 0)
        written = [b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for p, t in zip(m.pieces, m.types, strict=True)]
        self.output = np.frombuffer(b"".join(written), np.uint8)
        self.sizes = np.array([len(w) for w in written], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.cuts = self._boundaries()
        self.paths = common.Memo(self._ids, room)

    def _boundaries(self) -> regex.Pattern:
        """Stretches that no piece crosses: word marks with what follows them, up to a boundary.

        Letters fall into classes.  Classes that stand together within a piece
        make one; where a mark stands behind another letter, nothing is cut.
        """
        def kind(c: str) -> str:
            return "m" if c == MARK else "l" if regex.match(r"[\p{L}\p{M}]", c) else "d" if regex.match(r"\p{N}", c) else "o"

        joined = {(kind(a), kind(b)) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        if any(b == "m" and a != "m" for a, b in joined):
            return regex.compile(r"(?s).+")
        one = {k: {k} for k in "ldo"}
        for a, b in sorted(joined):
            if "m" not in (a, b) and one[a] is not one[b]:
                one[a] |= one[b]
                for k in one[b]:
                    one[k] = one[a]
        sets = {frozenset(x) for x in one.values()}
        plain = {frozenset("l"): r"[\p{L}\p{M}]", frozenset("d"): r"\p{N}", frozenset("o"): rf"[^{MARK} \p{{L}}\p{{M}}\p{{N}}]",
                 frozenset("do"): rf"[^{MARK} \p{{L}}\p{{M}}]", frozenset("ld"): r"[\p{L}\p{M}\p{N}]", frozenset("lo"): rf"[^{MARK} \p{{N}}]", frozenset("ldo"): rf"[^{MARK} ]"}
        return regex.compile("|".join([*(f"[{MARK} ]*{plain[x]}+" for x in sorted(sets, key=sorted, reverse=True)), f"[{MARK} ]+"]))

    # --- composition and shortest path ---

    def ending(self, codes: list[int], j: int) -> Iterator[tuple[int, int]]:
        """(start, id) of the pieces that end at place j, the shortest first."""
        arcs, final, state = self.pieces.arcs, self.pieces.final, 0
        for i in range(j - 1, -1, -1):
            state = arcs.get(state << 21 | codes[i])
            if state is not None and final[state] >= 0:
                yield i, final[state]
            elif i == j - 1:
                yield i, LETTER | codes[i]
            if state is None:
                return

    def shortest(self, letters: str) -> list[int]:
        """The outputs, as piece ids, of the path of least weight through normalised letters."""
        codes, weight = list(map(ord, letters)), self.pieces.weight
        if self.grammar.only:
            return self._only(codes)
        # at each place: of each grammar state that is reached, (weight, place before, state there, id)
        reached: list[dict] = [{self.grammar.start: (0.0, 0, None, None)}]
        for j in range(1, len(codes) + 1):
            there: dict = {}
            for i, piece in self.ending(codes, j):
                for state, cell in reached[i].items():
                    then, total = self.grammar.follow(state, piece), cell[0] + weight(piece)
                    if then not in there or total <= there[then][0]:
                        there[then] = total, i, state, piece
            reached.append(there)
        state, at, out = min(reached[-1], key=lambda x: reached[-1][x][0]), len(codes), []
        while at:
            _, at, state, piece = reached[at][state]
            out.append(piece)
        return out[::-1]

    def _only(self, codes: list[int]) -> list[int]:
        """``shortest`` for a grammar that leaves one path to a place: its weight is then the least, and the search at a place ends with it."""
        step, final, arcs = self.pieces.arcs.get, self.pieces.final, self.grammar.arcs
        states, before = [self.grammar.start], [0]
        for j in range(1, len(codes) + 1):
            state, i = 0, j
            while i:
                i -= 1
                state = step(state << 21 | codes[i])
                piece = -1 if state is None else final[state]
                if piece < 0 and i == j - 1:
                    piece = LETTER | codes[i]
                if piece >= 0 and arcs[states[i] << 22 | piece]:
                    states.append(piece)
                    before.append(i)
                    break
                if state is None:
                    i = 0
            if len(states) == j:
                raise ValueError(f"no path to place {j} of {''.join(map(chr, codes))!r}")
        out, at = [], len(codes)
        while at:
            out.append(states[at])
            at = before[at]
        return out[::-1]

    def _ids(self, stretch: str) -> bytes:
        """The ids, as 32-bit numbers, of a stretch of the text: normaliser, pieces and grammar composed with it."""
        out: list[int] = []
        for k in self.shortest(stretch if self.normaliser.map else self.normaliser.run(stretch, Normaliser.WORD)):
            if k < LETTER:
                out.append(k)
            elif len(self.bytes_) == 256:
                out += (self.bytes_[x] for x in chr(k - LETTER).encode("utf-8", "replace"))
            else:
                out.append(self.unknown)
        return np.array(out, np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if not text:
            return np.zeros(0, np.int32)
        if self.normaliser.map:
            text = self.normaliser.mapped(text)
        if self.model.squeeze:
            text = text.strip(" ")
            if not text:
                return np.zeros(0, np.int32)
        if self.model.prefix:
            text = " " + text
        if self.normaliser.map:
            text = self.normaliser.run(text, Normaliser.WORD)
        ids = np.frombuffer(b"".join(map(self.paths.__getitem__, self.cuts.findall(text))), np.int32)
        if len(self.bytes_) != 256:  # neighbouring unknown letters are one
            lost = ids == self.unknown
            ids = ids[~(lost & np.concatenate([[False], lost[:-1]]))]
        return ids

    # --- decoding: the machines read backwards ---

    def decode(self, ids: np.ndarray) -> str:
        size = self.sizes[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        text = self.output[np.repeat(self.starts[ids] - ends + size, size) + np.arange(total)].tobytes()
        if self.model.prefix and text.startswith(b" "):
            text = text[1:]
        return text.decode("utf-8", "replace")


_COMPILED: dict[int, Transducer] = {}


def compiled(data: bytes) -> Transducer:
    """The transducer of a model, compiled once in each Python worker."""
    key = hash(data)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(data)
    return _COMPILED[key]


def encode(docs: DataFrame, model: bytes, *, text_col: str = "text", ids_col: str = "piece_ids", same_col: str | None = "round_trip") -> DataFrame:
    """``docs`` with the ids of each text, and whether decoding them gives it back; columns of these names are replaced."""
    spark = docs.sparkSession
    common.small_batches(spark)
    kept = docs.drop(ids_col, *([same_col] if same_col else []))
    at = kept.columns.index(text_col)
    sent = spark.sparkContext.broadcast(model)  # of fixed size: the model file
    columns = kept.columns
    schema = common.plus(kept, (ids_col, T.ArrayType(T.IntegerType())), *([(same_col, T.BooleanType())] if same_col else []))

    def run(batches):
        machine = compiled(sent.value)
        for b in batches:
            texts = b.column(at).to_pylist()
            found = [None if t is None else machine.encode(t) for t in texts]
            sizes = np.array([0 if f is None else len(f) for f in found], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([f is None for f in found] + [False]))
            flat = np.concatenate([f for f in found if f is not None] or [np.zeros(0, np.int32)])
            more = [pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))]
            names = [*columns, ids_col]
            if same_col:
                more.append(pa.array([None if t is None else machine.decode(f) == t for t, f in zip(texts, found, strict=True)], pa.bool_()))
                names.append(same_col)
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=names)

    return kept.mapInArrow(run, schema)


def decode(docs: DataFrame, model: bytes, *, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids stand for (null for null ids); a column of that name is replaced."""
    spark = docs.sparkSession
    common.small_batches(spark)
    kept = docs.drop(text_col)
    columns = kept.columns
    at = columns.index(ids_col)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        machine = compiled(sent.value)
        for b in batches:
            texts = [None if x.as_py() is None else machine.decode(np.array(x.as_py(), np.int64)) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*columns, text_col])

    return kept.mapInArrow(run, common.plus(kept, (text_col, T.StringType())))
