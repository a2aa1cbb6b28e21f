"""Operator 2: SentencePiece BPE encoding by a merge-type prefix table, and decoding.

Method. The BPE encoding of every prefix of a text ends in one unique token. The
table stores that token for each prefix: an Aho-Corasick automaton over all
pieces lists the pieces that end at a position, and the one whose predecessor
(the last token of the shorter prefix) is *compatible* with it is stored. Two
tokens are compatible if the merge procedure, run on their joint characters,
leaves the border between them. Ids are then recovered backwards from the end.

Defined cases: a null text counts as empty; an empty text has no ids but the end
id; characters that no piece holds become byte pieces; texts of any length are
encoded whole (ids and decoding of one text are values of at most 2 GB, as strings
are in Spark); control pieces are never matched in a text. Rows are kept as they
are, repeated ones too, and columns of other names pass by untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serion.llm.words import byte_runs

SPACE = "▁"
END_ID = 2
#: Entries that a worker's table of encoded chunks holds before it starts anew.
CHUNK_CACHE = 500_000
PAIR_CACHE = 2_000_000
_NONE = float("-inf")
#: A piece holds neither a line end nor SPACE after another character, so no merge crosses these borders.
#: White space at both ends and in runs, capitals, a ligature, a full-width and a composed letter: identity keeps them.
_PROBE = "  A \ufb01\uff21 e\u0301  "
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Vocabulary(NamedTuple):
    """What a model file says of its pieces."""

    pieces: list[str]
    scores: list[float]
    kinds: str  # per piece: n ordinary, b byte, c control or unknown


def load_vocabulary(path: str) -> Vocabulary:
    """Reads a BPE model; ValueError unless it normalises by identity, has all byte pieces and no piece crosses a chunk's border."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    if m.normalize(_PROBE) != SPACE + _PROBE.replace(" ", SPACE):
        raise ValueError("the model normalises texts")
    if sum(map(m.is_byte, ids)) != 256:
        raise ValueError("the model has no byte fallback")
    pieces = [m.id_to_piece(i) for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    if any(len(_CHUNK.findall(p)) > 1 for p in pieces):
        raise ValueError("a piece crosses the border of a word or line")
    kind = lambda i: "b" if m.is_byte(i) else "c" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "n"
    return Vocabulary([m.id_to_piece(i) for i in ids], [m.get_score(i) for i in ids], "".join(map(kind, ids)))


class Codec:
    """Encoder and decoder of one vocabulary; lives in a worker process."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.pieces, self.scores, kinds = vocabulary
        self.size = len(self.pieces)
        self.score = {p: self.scores[i] for i, p in enumerate(self.pieces) if kinds[i] == "n"}
        self.id = {p: i for i, p in enumerate(self.pieces) if kinds[i] == "n"}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(self.size) if kinds[i] == "b"}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.silent = {i for i in range(self.size) if kinds[i] == "c"}
        self.length = [len(p) for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.chunks: dict[str, tuple[int, str, str]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of a and b leaves exactly these two tokens."""
        key = a * self.size + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            known = self.pairs[key] = self._border_stays(self.pieces[a], self.pieces[b])
        return known

    def _border_stays(self, a: str, b: str) -> bool:
        """Merges the best pair, the leftmost of equals, until none is left or the border is merged away."""
        score, parts, border = self.score.get, list(a + b), len(a)
        offers = [score(x + y, _NONE) for x, y in zip(parts, parts[1:], strict=False)]
        while offers and (best := max(offers)) > _NONE:
            i = offers.index(best)
            if i == border - 1:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del offers[i]
            if i < border:
                border -= 1
            if i:
                offers[i - 1] = score(parts[i - 1] + parts[i], _NONE)
            if i < len(offers):
                offers[i] = score(parts[i] + parts[i + 1], _NONE)
        return border == 1 and len(parts) == 2

    def _ids(self, chunk: str) -> list[int]:
        n = len(chunk)
        last = [-1] * (n + 1)  # last token of each prefix; -1: a character that no piece holds, or the start
        compatible, pairs, size = self.compatible, self.pairs, self.size
        for at, (t, length) in self.automaton.iter(chunk):
            if last[at + 1] < 0:
                before = last[at + 1 - length]
                if before < 0:
                    last[at + 1] = t
                else:
                    known = pairs.get(before * size + t)
                    if known or known is None and compatible(before, t):
                        last[at + 1] = t
        out: list[int] = []
        i = n
        while i:
            t = last[i]
            if t < 0:
                i -= 1
                out += [self.byte[x] for x in reversed(chunk[i].encode("utf-8", "replace"))]
            else:
                out.append(t)
                i -= self.length[t]
        out.reverse()
        return out

    @staticmethod
    def split(text: str) -> list[str]:
        """Chunks whose encodings are independent of each other."""
        return _CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text, the end id last."""
        return [t for c in self.split(text or "") for t in self._ids(c)] + [END_ID]

    def _pieces(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for t in ids:
            if t in self.byte_of:
                raw.append(self.byte_of[t])
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            if t not in self.silent:
                out.append(self.pieces[t].replace(SPACE, " "))
        return "".join(out) + _utf8(raw)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding sets before a text is taken off."""
        first = next((t for t in ids if t not in self.silent), END_ID)
        out = self._pieces(ids)
        return out[1:] if self.pieces[first].startswith(SPACE) else out

    def round_trip(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal joined by spaces, and their decoding; by chunks, which repeat a lot."""
        known, got = self.chunks, []
        for c in self.split(text or ""):
            x = known.get(c)
            if x is None:
                ids = self._ids(c)
                x = len(ids), " ".join(map(str, ids)), self._pieces(ids)
                if len(c) <= 64:
                    if len(known) >= CHUNK_CACHE:
                        known.clear()
                    known[c] = x
            got.append(x)
        counts, texts, decoded = zip(*got, strict=True) if got else ((), (), ())
        return sum(counts) + 1, " ".join([*texts, str(END_ID)]), "".join(decoded).removeprefix(" ")


def _utf8(raw: bytearray) -> str:
    """Valid sequences decoded; each byte that belongs to none becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[i : i + n]).decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_codecs: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's codec of a broadcast vocabulary."""
    if shared.id not in _codecs:
        _codecs.clear()
        _codecs[shared.id] = Codec(shared.value)
    return _codecs[shared.id]


class _Shared(NamedTuple):
    id: str
    variable: object

    @property
    def value(self) -> Vocabulary:
        return self.variable.value


def _share(df: DataFrame, model: str) -> _Shared:
    """A vocabulary is a file of fixed size (half a megabyte here), so it is broadcast."""
    import hashlib

    v = load_vocabulary(model)
    return _Shared(hashlib.sha256(repr(v).encode()).hexdigest(), df.sparkSession.sparkContext.broadcast(v))


def encode_texts(df: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) per row."""
    shared = _share(df, model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            for first, end in byte_runs(b.column(1)):
                part = b.slice(first, end - first)
                ids = [codec.encode(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(task, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, model: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) per row; null ids decode to the empty text."""
    shared = _share(df, model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x.as_py() or []) for x in b.column(1)], pa.string())], ["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(task, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip_texts(df: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_text, decoded) per row: encoded, then decoded again."""
    shared = _share(df, model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            for first, end in byte_runs(b.column(1)):
                part = b.slice(first, end - first)
                n, ids, decoded = zip(*[codec.round_trip(x.as_py()) for x in part.column(1)], strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_text", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(task, f"id {kind}, n_tokens long, ids_text string, decoded string").withColumnRenamed("id", id_col)
