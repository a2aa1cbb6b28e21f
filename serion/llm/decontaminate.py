"""Operator 8: benchmark decontamination over a distributed positional inverted index.

Method. The training texts are indexed in shards, as search engines do: a shard
is a run of documents, and its row of the index table holds every term's postings,
the sorted positions at which the shard's documents have it. The index depends on
the training texts alone, so it is built once and any number of test tables can be
searched in it. A test window is searched from its rarest term (by occurrences in
the whole corpus): that term's positions, less its offset in the window, are
intersected with the postings of the next rarer terms until nothing is left or
all terms agree. Proximity matches ask only that the rarest terms of an item lie
within a span of words of one document.

(A shard intersects by looking the other terms up at the place where the window
would have them, since a position holds one term; the result is that of merging lists.)

Sharding by document keeps each term's postings, however frequent, in pieces of
bounded size; nothing is shuffled by term. Equal test texts are searched once and get
their items' ids back by a join. The distinct texts are searched in blocks of bounded
bytes, as flat arrays: windows are ordered by their rarest term, and items, too, so a
shard looks only at those whose rarest term it has, CANDIDATES at a time.

Defined cases: a null text has no words and is never contaminated; an item
without words (or null) matches nothing; an item shorter than the window is one
window; repeated documents are judged one by one; items with equal ids count once,
and so do items without one: together they are one item, null, last in the lists.
An empty test table leaves every document clean; a null doc_id is kept as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serion.llm.storage import Scratch, free_name
from serion.llm.words import NOT_ALNUM, hash_words, slices, words

#: Words of one window.
WINDOW = 13
#: Bytes of text that one shard of the index covers, unless a single text is longer.
SHARD_BYTES = 8 << 20
#: Bytes of test texts that one pass over the index searches (its arrays take about five times that).
BLOCK_BYTES = 16 << 20
#: Bytes that a text counts for besides its own.
TEXT_BYTES = 64
#: A proximity match: this many rarest terms of an item within this many words.
NEAR_TERMS, NEAR_SPAN = 4, 40
#: Pairs of a window and a place that a shard looks at together, unless one term has more postings.
CANDIDATES = 1 << 18

_INDEX = "shard string, ids array<{id}>, first array<int>, n_words array<int>, terms array<long>, counts array<int>, postings binary"


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard: documents, their first positions, terms (64-bit hashes in order) and postings.

    Between two documents one position stays free, so no window runs over a border.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, used, kind = _Shard(), 0, 0, None
        for b in batches:
            kind = b.column(0).type
            for first, end, at, data in slices(b.column(1)):
                if size and size + len(data) > SHARD_BYTES:
                    yield shard.batch(kind)
                    shard, size, used = _Shard(), 0, 0
                w = words(at, data, NOT_ALNUM)
                n = np.diff(w.bounds)
                shard.ids.append(b.column(0).slice(first, end - first))
                shard.first.append(w.bounds[:-1] + np.arange(len(n)) + used)
                shard.n_words.append(n)
                shard.term.append(w.hash)
                # word k of row r stands at used + k + r
                shard.position.append((np.arange(len(w.hash)) + np.repeat(np.arange(len(n)), n) + used).astype(np.int32))
                used += len(w.hash) + len(n)
                size += len(data)
        if shard.ids:
            yield shard.batch(kind)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(task, _INDEX.format(id=kind))


class _Shard:
    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.first: list[np.ndarray] = []
        self.n_words: list[np.ndarray] = []
        self.term: list[np.ndarray] = []
        self.position: list[np.ndarray] = []

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        import uuid

        term, position = np.concatenate(self.term), np.concatenate(self.position)
        order = np.argsort(term, kind="stable")
        terms, counts = np.unique(term[order], return_counts=True)
        row = [uuid.uuid4().hex, pa.concat_arrays(self.ids).to_pylist(), np.concatenate(self.first), np.concatenate(self.n_words), terms.view(np.int64), counts, position[order].tobytes()]
        kinds = [pa.string(), pa.list_(kind), *[pa.list_(pa.int32())] * 2, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        names = ["shard", "ids", "first", "n_words", "terms", "counts", "postings"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)


class Items(NamedTuple):
    """A block of distinct test texts as flat arrays."""

    numbers: np.ndarray
    vocabulary: np.ndarray  # distinct word hashes in order
    tokens: np.ndarray  # numbers of all items' words, one item behind the other
    bounds: np.ndarray  # the first token of each item, and the end

    @staticmethod
    def read(texts: DataFrame) -> Items:
        """The texts (number, text) of a block (of bounded bytes) that have words."""
        rows = texts.select("number", "text").collect()
        found = sorted(((r.number, h) for r, h in zip(rows, hash_words([r.text for r in rows], NOT_ALNUM), strict=True) if len(h)), key=lambda x: x[0]) if rows else []
        every = np.concatenate([h for _, h in found]) if found else np.zeros(0, np.uint64)
        vocabulary, tokens = np.unique(every, return_inverse=True)
        return Items(np.array([i for i, _ in found], np.int64), vocabulary, tokens.astype(np.int32), np.concatenate([[0], np.cumsum([len(h) for _, h in found])]).astype(np.int64))


def term_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of each term of a block's vocabulary in the whole corpus; a row per term reaches the driver."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for b in batches:
            for k in range(b.num_rows):
                terms, counts = _list(b, "terms", k).view(np.uint64), _list(b, "counts", k)
                number, at = _common(shared.value, terms)
                total[number] += counts[at]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["t", "c"])

    got = index.select("terms", "counts").mapInArrow(task, "t long, c long").groupBy("t").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(len(vocabulary), np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def _list(b: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    """One row's values of a list column."""
    return b.column(b.schema.get_field_index(name))[row].values.to_numpy(zero_copy_only=False)


def _common(vocabulary: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes that both have, in the one and in the other; both in order."""
    few, many = (vocabulary, terms) if len(vocabulary) < len(terms) else (terms, vocabulary)
    if not len(few):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    same = np.flatnonzero(many[at] == few)
    return (same, at[same]) if few is vocabulary else (at[same], same)


class Plan(NamedTuple):
    """What every shard needs to search a block: some twenty bytes per test word."""

    items: Items
    counts: np.ndarray  # of each vocabulary term in the corpus
    width: np.ndarray  # words of a window, by item
    start: np.ndarray  # first token of each window, windows ordered by their rarest term
    item: np.ndarray  # of each window
    offset: np.ndarray  # place of the rarest term in each window
    by_term: np.ndarray  # first window of each term, and the end
    rare: np.ndarray  # items x NEAR_TERMS: the rarest terms of each item, rarest first; -1: none
    near: np.ndarray  # items by their rarest term
    near_by_term: np.ndarray  # first place of each term among them, and the end


def plan(items: Items, counts: np.ndarray, window: int = WINDOW) -> Plan:
    size = np.diff(items.bounds)
    width = np.minimum(size, window)
    n = size - width + 1
    start = np.repeat(items.bounds[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    wide = np.repeat(width, n)
    own = counts[items.tokens]
    offset = np.zeros(len(start), np.int16)
    least = own[start]
    for k in range(1, window):
        inside = np.flatnonzero(wide > k)
        fewer = inside[own[start[inside] + k] < least[inside]]
        least[fewer] = own[start[fewer] + k]
        offset[fewer] = k
    term = items.tokens[start + offset]
    order = np.argsort(term, kind="stable")
    rare = np.full((len(size), NEAR_TERMS), -1, np.int32)
    for i, (a, z) in enumerate(zip(items.bounds[:-1].tolist(), items.bounds[1:].tolist(), strict=True)):
        each = list(dict.fromkeys(items.tokens[a:z][np.argsort(own[a:z], kind="stable")].tolist()))[:NEAR_TERMS]
        rare[i, : len(each)] = each
    terms = np.arange(len(items.vocabulary) + 1)
    near = np.argsort(rare[:, 0], kind="stable")
    item = np.repeat(np.arange(len(size), dtype=np.int32), n)[order]
    return Plan(items, counts, width, start[order], item, offset[order], np.searchsorted(term[order], terms), rare, near, np.searchsorted(rare[near, 0], terms))


class _Postings:
    """Postings of the vocabulary's terms in one shard: (term, position) as sorted 64-bit numbers."""

    def __init__(self, vocabulary: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray):
        self.term, at = _common(vocabulary, terms)
        order = np.argsort(self.term)
        self.term, at = self.term[order], at[order]
        self.n = counts[at].astype(np.int64)
        begin = (np.cumsum(counts, dtype=np.int64) - counts)[at]
        self.first = np.cumsum(self.n) - self.n
        pick = np.arange(int(self.n.sum())) + np.repeat(begin - self.first, self.n)
        self.position = positions[pick].astype(np.int64)
        of = np.repeat(self.term, self.n)
        self.key = (of.astype(np.int64) << 32) | self.position
        # the same postings by position: a position holds one term
        self.at = np.full(int(self.position.max(initial=0)) + 2, -1, np.int32)
        self.at[self.position] = of

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each position is in its term's postings."""
        return self.at[np.minimum(position, len(self.at) - 1)] == term

    def any_between(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term has a posting in low .. high."""
        base = term.astype(np.int64) << 32
        at = np.searchsorted(self.key, base | np.maximum(low, 0))
        return (at < len(self.key)) & (self.key[np.minimum(at, len(self.key) - 1)] <= (base | high)) & (high >= 0) if len(self.key) else np.zeros(len(term), bool)

    def pairs(self, number: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number, position) of every posting of the term that stands at ``place`` here, in runs of about CANDIDATES."""
        n = self.n[place]
        done, total = 0, np.cumsum(n)
        while done < len(n):
            before = int(total[done - 1]) if done else 0
            end = max(done + 1, int(np.searchsorted(total, before + CANDIDATES, "right")))
            k = n[done:end]
            at = np.arange(int(k.sum())) + np.repeat(self.first[place[done:end]] - (np.cumsum(k) - k), k)
            yield np.repeat(number[done:end], k), self.position[at]
            done = end


def exact_matches(p: Plan, have: _Postings) -> tuple[np.ndarray, np.ndarray]:
    """(item, position) of every window of a block that a shard holds."""
    begin, end = p.by_term[have.term], p.by_term[have.term + 1]
    n = end - begin
    window = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
    items, starts = [], []
    for w, at in have.pairs(window, np.repeat(np.arange(len(n)), n)):
        at = at - p.offset[w]
        alive = at >= 0
        w, at = w[alive], at[alive]
        width = p.width[p.item[w]]
        # terms of each window, the rarest first; places beyond a window's end come last
        few, which = np.unique(w, return_inverse=True)
        place = p.start[few][:, None] + np.arange(int(width.max(initial=1)))
        outside = np.arange(place.shape[1])[None, :] >= p.width[p.item[few]][:, None]
        often = p.counts[p.items.tokens[np.minimum(place, len(p.items.tokens) - 1)]]
        order = np.argsort(np.where(outside, np.iinfo(np.int64).max, often), axis=1, kind="stable")
        for k in range(1, order.shape[1]):
            if not len(w):
                break
            step = order[which, k]
            held = (k >= width) | have.has(p.items.tokens[np.minimum(p.start[w] + step, len(p.items.tokens) - 1)], at + step)
            w, at, width, which = w[held], at[held], width[held], which[held]
        items.append(p.item[w])
        starts.append(at)
    return (np.concatenate(items), np.concatenate(starts)) if items else (_NOTHING, _NOTHING)


_NOTHING = np.zeros(0, np.int64)


def near_matches(p: Plan, have: _Postings, first: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, row): the item's rarest terms all lie within NEAR_SPAN / 2 words of the rarest one, in one document."""
    there = np.zeros(len(p.items.vocabulary) + 1, bool)  # the last one stands for no term
    there[have.term] = True
    there[-1] = True
    begin, n = p.near_by_term[have.term], p.near_by_term[have.term + 1] - p.near_by_term[have.term]
    item = p.near[np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)]
    item = item[there[p.rare[item]].all(1)]
    items, rows = [], []
    for i, at in have.pairs(item, np.searchsorted(have.term, p.rare[item, 0])):
        row = np.searchsorted(first, at, "right") - 1
        low, high = np.maximum(at - NEAR_SPAN // 2, first[row]), np.minimum(at + NEAR_SPAN // 2, first[row] + n_words[row] - 1)
        for k in range(1, NEAR_TERMS):
            held = (p.rare[i, k] < 0) | have.any_between(np.maximum(p.rare[i, k], 0), low, high)
            i, row, low, high = i[held], row[held], low[held], high[held]
        items.append(i)
        rows.append(row)
    return (np.concatenate(items), np.concatenate(rows)) if items else (_NOTHING, _NOTHING)


_HITS = "shard string, row int, id {id}, n_words long, n_hit long, span_start array<int>, span_end array<int>, items array<long>, near_items array<long>"


def search(index: DataFrame, items: Items, *, window: int = WINDOW, found_only: bool = False) -> DataFrame:
    """One row per indexed document (found_only: with a match): words hit by exact windows, their spans, items with windows, items nearby."""
    shared = index.sparkSession.sparkContext.broadcast(plan(items, term_counts(index, items.vocabulary), window))
    id_kind = index.schema["ids"].dataType.elementType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield _search_shard(b.slice(k, 1), shared.value, found_only)

    return index.mapInArrow(task, _HITS.format(id=id_kind))


def _lists(p: Plan, item: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """The numbers of each row's texts."""
    ranked = np.unique(row * len(p.items.numbers) + item) if len(item) else _NOTHING
    row, item = np.divmod(ranked, max(len(p.items.numbers), 1))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), pa.array(p.items.numbers[item]))


def _search_shard(b: pa.RecordBatch, p: Plan, found_only: bool) -> pa.RecordBatch:
    first, n_words, counts = (_list(b, x, 0).astype(np.int64) for x in ("first", "n_words", "counts"))
    have = _Postings(p.items.vocabulary, _list(b, "terms", 0).view(np.uint64), counts, np.frombuffer(b.column(6)[0].as_py(), np.int32))
    n = len(first)
    cover = np.zeros(int(first[-1] + n_words[-1] + 2) + 1, np.int32)
    item, start = exact_matches(p, have)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + p.width[item], -1)
    items = _lists(p, item, np.searchsorted(first, start, "right") - 1, n)
    near = _lists(p, *near_matches(p, have, first, n_words), n)
    covered = np.cumsum(cover) > 0
    sums = np.concatenate([[0], np.cumsum(covered)])
    n_hit = sums[first + n_words] - sums[first]
    span_start, span_end = [[] for _ in range(n)], [[] for _ in range(n)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    for a, z in edge.reshape(-1, 2).tolist():
        row = int(np.searchsorted(first, a, "right")) - 1
        span_start[row].append(a - int(first[row]))
        span_end[row].append(z - int(first[row]))
    ids, ints = b.column(1), pa.list_(pa.int32())
    out = pa.RecordBatch.from_arrays(
        [pa.array([b.column(0)[0].as_py()] * n, pa.string()), pa.array(np.arange(n), pa.int32()), ids.values.slice(ids.offsets[0].as_py(), n), pa.array(n_words), pa.array(n_hit), pa.array(span_start, ints), pa.array(span_end, ints), items, near],
        ["shard", "row", "id", "n_words", "n_hit", "span_start", "span_end", "items", "near_items"],
    )
    return out.filter(pa.array((np.diff(items.offsets.to_numpy()) > 0) | (np.diff(near.offsets.to_numpy()) > 0))) if found_only else out


def decontaminate(docs: DataFrame, test: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document row: (id_col, n_words, n_hit, span_start, span_end, items, near_items)."""
    scratch = Scratch(docs.sparkSession, "postings")
    index = scratch.save("index", build_index(docs, id_col=id_col, text_col=text_col))
    out = search_table(index, test, item_col=item_col, item_text_col=item_text_col, window=window)
    scratch.drop("index")
    return out.withColumnRenamed("id", id_col)


def search_table(index: DataFrame, test: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per indexed document: (id, n_words, n_hit, span_start, span_end, items, near_items), for a whole test table.

    index: a stored table of build_index; it is not read after the call. The lists hold
    the distinct ids, in order (null last), of all items whose text was found.
    """
    scratch = Scratch(index.sparkSession, "contamination")
    said = test.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    texts = scratch.save("texts", said.select("text").distinct().withColumn("number", F.monotonically_increasing_id()))
    found = scratch.save("found", _search_texts(index, texts, window))
    items = said.join(texts, "text").select("number", F.struct("item").alias("item")).distinct()
    met = found.select("shard", "row", F.explode("items").alias("number"), F.lit(False).alias("near")).union(found.select("shard", "row", F.explode("near_items"), F.lit(True)))
    ids = lambda near: F.transform(F.array_sort(F.collect_set(F.when(F.col("near") == near, F.struct(F.col("item.item").isNull(), "item.item")))), lambda x: x["item"])
    lists = met.join(items, "number").groupBy(F.col("shard").alias("of_shard"), F.col("row").alias("of_row")).agg(ids(False).alias("found_items"), ids(True).alias("found_near"))
    out = found.join(lists, (F.col("shard") == F.col("of_shard")) & (F.col("row") == F.col("of_row")), "left")
    none = F.array().cast("array<string>")
    return out.select("id", "n_words", "n_hit", "span_start", "span_end", F.coalesce("found_items", none).alias("items"), F.coalesce("found_near", none).alias("near_items"))


def _search_texts(index: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """search() for distinct texts (number, text) of any number, in blocks of bounded bytes.

    What several blocks find in a document is merged by its place in the index. One
    block, the usual case, shuffles nothing but the term counts.
    """
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") + TEXT_BYTES), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(size) // BLOCK_BYTES))
    if n_blocks == 1:
        return search(index, Items.read(texts), window=window)
    place = F.pmod(F.xxhash64("number"), F.lit(n_blocks))
    out = None
    for k in range(n_blocks):
        found = search(index, Items.read(texts.where(place == k)), window=window, found_only=k > 0)
        out = found if out is None else out.union(found)
    spans = F.flatten(F.collect_list(F.arrays_zip("span_start", "span_end")))
    merged = lambda c: F.flatten(F.collect_list(c)).alias(c)
    out = out.groupBy("shard", "row").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), spans.alias("spans"), merged("items"), merged("near_items"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["span_start"], x["span_end"] - 1)))))
    n_hit = F.when(F.size("spans") > 0, hit).otherwise(0).cast("long").alias("n_hit")
    return out.select("shard", "row", "id", "n_words", n_hit, F.col("spans.span_start").alias("span_start"), F.col("spans.span_end").alias("span_end"), "items", "near_items")


def with_contamination(found: DataFrame) -> DataFrame:
    """Adds the contamination verdict: at least one word in twenty lies in a test window."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, test: DataFrame, *, text_col: str = "text", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows of docs, all columns, that the verdict leaves; rows are told apart by a key of their own, under a name that docs has not."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    key = free_name(docs, "_row")
    keyed = scratch.save("docs", docs.withColumn(key, F.expr("uuid()")))
    index = scratch.save("index", build_index(keyed, id_col=key, text_col=text_col))
    said = test.select(F.col(item_text_col).alias("text")).where("text IS NOT NULL").distinct()
    texts = scratch.save("texts", said.withColumn("number", F.monotonically_increasing_id()))
    found = with_contamination(_search_texts(index, texts, window))
    bad = scratch.save("bad", found.where("contaminated").select(F.col("id").alias(key)))
    scratch.drop("index", "texts")
    return keyed.join(bad, key, "left_anti").drop(key)
