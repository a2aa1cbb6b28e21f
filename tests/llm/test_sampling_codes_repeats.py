"""Operators 11 to 13 against plain versions, on awkward rows and on the smallest tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from serion.llm import importance, oracles, substring_dedup, vector_codes
from serion.llm import queries as q
from serion.llm.storage import table
from serion.llm.words import SPACE, Spans, slices, words
from tests.llm import brute
from tests.llm.test_operators import DOCS, SF, TEXTS, _docs

ROWS = [*DOCS, (None, TEXTS[6]), (None, TEXTS[16]), (3, TEXTS[16]), (40, TEXTS[16]), (40, TEXTS[16]), (-5, "solo " + TEXTS[17])]


def _duck(name, rows=None):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = con.execute(oracles.ORACLES[name])
    return [d[0] for d in r.description], r.fetchall()


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_vector_codes", "op13_substring_dedup"])
def test_query_equals_sql(spark, name):
    names, want = _duck(name)
    got = q.QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


# 11 ------------------------------------------------------------------------------------------------


def _buckets(t, n, m):
    w = brute.ALNUM.findall(brute.lower(t))
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % m for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def _resampled(docs, target, n=1, m=10_000, least=20, percent=10):
    mine = [(i, *_buckets(t, n, m)) for i, t in docs]
    s, t = Counter(b for _, f, _ in mine for b in f), Counter(b for x in target for b in _buckets(x, n, m)[0])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + m) / ((s[b] + 1) * (t.total() + m))))
    out = []
    for i, f, words in mine:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("n", "m", "least", "percent"), [(1, 10_000, 20, 10), (3, 512, 1, 60), (2, 65_536, 0, 100), (1, 7, 20, 0)])
def test_resampling(spark, n, m, least, percent):
    target = ["the lazy dog", None, "", "farm house near our river w1 w2"]
    wanted = spark.createDataFrame([(1, t) for t in target], "doc_id int, text string")
    got = importance.resample(_docs(spark, ROWS), wanted, max_words=n, buckets=m, min_words=least, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == _resampled(ROWS, target, n, m, least, percent)


def test_resampling_empty(spark):
    none, some = _docs(spark, []), _docs(spark)
    assert importance.resample(none, none).collect() == []
    assert sorted(map(tuple, importance.resample(some, none).collect()), key=str) == _resampled(DOCS, [])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=200), min_size=1, max_size=8))
def test_crc_of_spans(parts):
    data, end = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    got = importance.crc_spans(data, end - [len(p) for p in parts], end, np.zeros(len(parts), np.uint32))
    assert got.tolist() == [zlib.crc32(p) for p in parts]


# 12 ------------------------------------------------------------------------------------------------


def _codes(rows, parts, entries, rounds):
    """(id, code, error, error of the label) per kept row and the codebooks: every entry tried for every part."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) if kept else 0
    able = [r for r in kept if len(r[1]) == size and all(abs(x) < 1e5 for x in r[1])]
    wide = size // parts
    cut = [[tuple(math.floor(4096 * x) for x in v[p * wide : (p + 1) * wide]) for p in range(parts)] for _, v, _ in able]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        best = [[min((far(c[p], e), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]
        for p in range(parts) if k < rounds else ():
            for j in range(len(books[p])):
                own = [c[p] for c, b in zip(cut, best, strict=True) if b[p][1] == j]
                if own:
                    books[p][j] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    out = {id(r): ("".join(f"{j:02x}" for _, j in b), sum(d for d, _ in b)) for r, b in zip(able, best, strict=True)} if able else {}
    total = {label: [out[id(r)][1] for r in able if r[2] == label] for label in {r[2] for r in kept}}
    return [(r[0], *out.get(id(r), (None, None)), sum(total[r[2]]) if total[r[2]] else None) for r in kept], books


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, id int, code string")


def test_codes(spark):
    pick = random.Random(4)
    rows = [(i, [pick.choice([-1.5, 0.0, 0.25, 0.25, pick.gauss(0, 1)]) for _ in range(8)], pick.choice([1, 1, 1, 2, None])) for i in range(300)]
    rows += [rows[3], rows[3], (None, rows[4][1], 9), (-1, None, 1), (-2, [float("nan")] * 8, 1), (-3, [float("inf")] * 8, 2), (-4, [None, 1.0], 2), (500, [1.0, 2.0], 5), (501, [3e9] + [0.0] * 7, 5), (502, [], 5)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]
    for entries, rounds in ((16, 6), (5, 2), (256, 1)):
        got = vector_codes.compress(_vectors(spark, rows), parts=4, entries=entries, rounds=rounds)
        want, books = _codes(rows, 4, entries, rounds)
        assert sorted(map(tuple, got.rows.select("vec_id", "code", "error", "label_error").collect()), key=str) == sorted(want, key=str)
        assert got.books.tolist() == [[list(e) for e in b] for b in books]


def test_codes_of_few(spark):
    assert vector_codes.compress(_vectors(spark, [])).rows.collect() == []
    assert vector_codes.compress(_vectors(spark, [(1, None, 1)])).rows.collect() == []
    assert [r.code for r in vector_codes.compress(_vectors(spark, [(1, [], 1), (2, [], None)])).rows.collect()] == ["00" * 8] * 2
    assert [(r.code, r.error) for r in vector_codes.compress(_vectors(spark, [(1, [0.5] * 8, 1)])).rows.collect()] == [("00" * 8, 0)]
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(_vectors(spark, [(1, [0.5] * 9, 1)]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=2, max_size=2), min_size=1, max_size=40), st.lists(st.lists(st.integers(-4, 4), min_size=2, max_size=2), min_size=1, max_size=9), st.randoms())
def test_nearest_entry(rows, book, pick):
    x, b = np.array(rows, np.int64), np.array(book, np.int64)
    code, error = vector_codes.nearest(x, b, np.array([pick.randrange(len(book)) for _ in rows]))
    d = ((x[:, None] - b[None]) ** 2).sum(2)
    assert code.tolist() == d.argmin(1).tolist()
    assert error.tolist() == d.min(1).tolist()


# 13 ------------------------------------------------------------------------------------------------


def _kept(rows, n=13):
    least, said = {}, [(math.inf if i is None else i, brute.WORD.findall(t or "")) for i, t in rows]
    for i, w in said:
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            least[x] = min(least.get(x, math.inf), i)
    out = []
    for (i, _), (j, w) in zip(rows, said, strict=True):
        gone = {k + o for k in range(len(w) - n + 1) if least[tuple(w[k : k + n])] < j for o in range(n)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def _spoken(pick):
    """Texts that share passages of all lengths, few words, runs and cycles."""
    prose = [f"v{pick.randrange(400)}" for _ in range(3000)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(pick.randrange(6)):
            a, n = pick.randrange(2900), pick.choice([5, 12, 13, 14, 20, 60, 300])
            w += pick.choice([prose[a : a + n], ["la"] * n, ["do", "re"] * n, ["a", "b", "c"] * n, [f"own{pick.random()}" for _ in range(n)]])
        rows.append((pick.choice([i, i, i, 7, None]), pick.choice([" ", "\n", " \t "]).join(w)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_repeats(spark, seed, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", [1 << 20, 900, 1][seed])  # many blocks as well as one
    rows = _spoken(random.Random(seed)) + ROWS
    got = substring_dedup.remove_repeats(_docs(spark, rows).repartition(3))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == _kept(rows)


def test_repeats_of_other_widths_and_none(spark):
    rows = _spoken(random.Random(9))
    for n in (6, 25):
        assert sorted(map(tuple, substring_dedup.remove_repeats(_docs(spark, rows), width=n).collect()), key=str) == _kept(rows, n)
    assert substring_dedup.remove_repeats(_docs(spark, [])).collect() == []
    assert sorted(substring_dedup.remove_repeats(_docs(spark, [(1, None), (2, "")])).collect()) == [(1, 0, 0, ""), (2, 0, 0, "")]


def _cut(text):
    ((_, _, at, data),) = slices(table_column(text), 1 << 30)
    return words(at, data, SPACE, lower=False)


def table_column(text):
    import pyarrow as pa

    return pa.array([text])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=60), st.lists(st.sampled_from("abcd"), min_size=13, max_size=30), st.lists(st.sampled_from("abcd"), max_size=60))
def test_anchors_of_equal_windows_agree(before, shared, after):
    """A window has the same anchor wherever it stands."""
    alone, inside = _cut(" ".join(shared)), _cut(" ".join([*before, *shared, *after]))
    found = []
    for w, free in ((alone, np.arange(len(shared) - 12)), (inside, np.arange(len(shared) - 12) + len(before))):
        n = len(w.hash)
        grams = Spans(w.hash).of(np.arange(n), np.minimum(np.arange(n) + 6, n))
        found.append(grams[substring_dedup.anchors(w, free, grams, 1, 6, 13)].tolist())
    # by its own words, even if a symbol at the border of the text is no candidate there
    for p, (a, b) in enumerate(zip(*found, strict=True)):
        assert a == b, p


def test_reveal_settles_copies(spark):
    """Most windows of a copied text end in the first round, by a few keys."""
    text = " ".join(f"u{i % 977}x{i}" for i in range(3000))
    w = _cut(text)
    start, end, _ = substring_dedup.revealing(w, substring_dedup.REVEAL_ROUNDS, 13)
    covered = np.zeros(3001, np.int64)
    np.add.at(covered, start, 1)
    np.add.at(covered, end - 12, -1)
    assert (np.cumsum(covered)[: 3000 - 12] > 0).mean() > 0.9
    assert len(start) < 200
