"""The numbered operators against brute force, on awkward rows and on the smallest tables."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from serion.llm import chat_format, decontaminate, html_extract, jaccard_join, language_id, lm_scoring, oracles, quality_classifier, quality_rules, sentencepiece_codec, url_filters
from serion.llm import queries as q
from serion.llm.storage import table
from tests.llm import brute

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")

SAID = "the quick brown fox jumps over the lazy dog and runs far away from the old farm house near our river"
#: Null, empty, blank, short, one very long, equal, nearly equal, repeated ids, foreign marks.
TEXTS = [
    None, "", " \t\n", "one", "One TWO three", "one two three", SAID, SAID.upper(), SAID, SAID + " today", SAID.replace("lazy", "tired"), "x " * 3000, "Ünïcödé — „Wörter“ \u3000 weit\u00a0weg 🤖",
    "a\nb\na\n\n \nb", "\x00\x0b\x0c\r", "long" * 50_000, " ".join(f"w{i}" for i in range(2000)), " ".join(f"w{i}" for i in range(1990)) + " end", "#$%&|<> ** ##",
]
DOCS = [(i, t) for i, t in enumerate(TEXTS)]


def _docs(spark, rows=DOCS):
    """Rows with columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "k", 2.0, "i") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, label double, id string")


@pytest.fixture(scope="module")
def docs(spark):
    return _docs(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return _docs(spark, [])


# 1 -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain text &amp; more", "plain text & more"),
        ("<p>one<p>two &eacute;<br>three", "one two é three"),
        ("<html><head><title>T</title></head><body><nav><a href=x>menu</a></nav><article><h1>Head</h1><p>Some <b>bold</b>  text\n here.</p><p>More.</p></article><footer>foot</footer>", "Head Some bold text here. More."),
        ("<body><header>site</header><div class='sidebar'><p>side side side</p></div><main><header><h1>T</h1></header><p>Hello wor<i>ld</i>.</p><div id=comments><p>first! very nice post, thanks a lot</p></div></main><form>name</form>", "T Hello world."),
        ("<div><div class='post'><p>" + "word " * 40 + "</p><p>tail</p></div><ul><li><a href=1>a b c</a><li><a href=2>d e f</a></ul></div>", " ".join(["word"] * 40) + " tail"),
        ("<p>a<script>if (a < b) { x = '</p>' }</script>b<!-- no <p>comment --></p>", "ab"),
        ("<div>" * 3000 + "deep" + "</div>" * 10, "deep"),
        ("<p>x < y</p><unknown>z</unknown", "x < y z"),
    ],
)
def test_main_text(page, want):
    assert html_extract.main_text(page) == want


def _para(k, n=30):
    return "<p>" + " ".join(f"word{k}{i}" for i in range(n)) + ".</p>"


def _said(ks):
    return " ".join(" ".join(f"word{k}{i}" for i in range(30)) + "." for k in ks)


_LINKS = "<div>" + "".join(f"<a href=/{i}>link {i}</a> " for i in range(8)) + "</div>"
_ARTICLE = "".join(map(_para, "abc"))
#: Pages whose furniture no element or class names: only densities tell the text.
DENSE = [
    (f"<body>{_LINKS}<div><span>Buy now, cheap pills for all of you today</span></div><div><div><h1>Head</h1>{_ARTICLE}</div></div>{_LINKS}<div>Copyright by nobody</div></body>", "Head " + _said("abc")),
    (f"<body>{_LINKS}<h1>Head</h1>{_ARTICLE}<div>Buy now</div>{_LINKS}</body>", "Head " + _said("abc")),
    (f"<body>{_LINKS}<div><h1>Head</h1><div class=s>{_ARTICLE}</div><div class=s>{_para('d')}</div></div><div>Last</div></body>", "Head " + _said("abcd")),
    (f"<body><div><div>{_LINKS}</div><div>{_ARTICLE}<ul><li>point one<li>point two</ul></div></div></body>", _said("abc") + " point one point two"),
]
#: Pages whose class names speak of furniture around or beside the text.
NAMED = [
    *[(f"<body>{_LINKS}<div class='{c}'>{_ARTICLE}</div><div>(c) someone</div></body>", _said("abc")) for c in ("content no-sidebar", "content with-sidebar", "post-header", "layout--has-header", "share-story", "sidebar", "story")],
    (f"<body><form>{_LINKS}<div>{_ARTICLE}</div><div class=comments>{_para('z')}</div></form></body>", _said("abc")),
    *[(f"<body><div id=x>{_ARTICLE}</div><div class='{c}'>{_para('q') * 9}</div></body>", _said("abc")) for c in ("comments", "comment-list", "site-footer", "mainNav")],
    (f"<body><aside>{_para('q')}</aside><article>{_ARTICLE}<ul><li><a href=x>ref one</a></li></ul><div role=search>find</div></article><dialog>Notice</dialog></body>", _said("abc") + " ref one"),
]


@pytest.mark.parametrize(("page", "want"), DENSE + NAMED)
def test_main_text_of_layouts(page, want):
    assert html_extract.main_text(page) == want


def test_density_decides(monkeypatch):
    monkeypatch.setattr(html_extract, "_density", lambda *_: 0.0)
    assert all(html_extract.main_text(page) != want for page, want in DENSE)


def test_awkward_page_rows(spark):
    long = "<div>" + _para("a", 300_000) + "</div>"
    rows = [(1, "u", None, 5, 1.0), (1, "u", "", 6, 1.0), (2, None, "<p>a b</p>", 7, 2.0), (2, None, "<p>a b</p>", 7, 2.0), (None, "v", long, 8, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long, k0 double")
    got = html_extract.extract_pages(df, keep=("page_id", "url", "k0")).collect()
    assert sorted(((r.page_id or 0, r.url or "", r.k0 or 0.0, len(r.text), r.n_chars) for r in got)) == sorted([(1, "u", 1.0, 0, 0), (1, "u", 1.0, 0, 0), (2, "", 2.0, 3, 3), (2, "", 2.0, 3, 3), (0, "v", 0.0, len(long) - 18, len(long) - 18)])


def test_pages(spark):
    import html
    import re

    got = {r.page_id: r for r in q.op1_html_extraction(spark, SF).collect()}
    pages = table(spark, SF, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:p|br|h1)>", " ", article).replace("<b>", "").replace("</b>", "")).split())
        assert (got[p.page_id].text, got[p.page_id].n_chars) == (want, len(want))


def test_pages_empty_table(spark):
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 2 -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(sentencepiece_codec.load_vocabulary(MODEL))


_BITS = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "▁", "é", "🤖", "\t", "\x00", "<s>", "</s>", "ing", "Sch", "中", "�", "=" * 9, " " * 17, "0"]), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(_BITS, st.text(max_size=60)))
def test_codec_is_the_library(library, codec, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    ids = library.encode(text, add_eos=True)
    assert codec.encode(text) == ids
    assert codec.decode(ids) == library.decode(ids)
    assert codec.round_trip(text) == (len(ids), " ".join(map(str, ids)), library.decode(ids))


def test_codec_decodes_any_ids(library, codec):
    rng = random.Random(3)
    for _ in range(2000):
        ids = [rng.randrange(1, 260) if rng.random() < 0.5 else rng.randrange(260, 32000) for _ in range(rng.randrange(8))]
        assert codec.decode(ids) == library.decode(ids)


def test_round_trip_rows(spark, docs, none, library):
    got = {r.doc_id: r for r in sentencepiece_codec.round_trip_texts(docs, MODEL).collect()}
    for i, t in DOCS:
        ids = library.encode(t or "", add_eos=True)
        assert (got[i].n_tokens, got[i].ids_text, got[i].decoded) == (len(ids), " ".join(map(str, ids)), library.decode(ids))
    back = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_texts(docs, MODEL), MODEL)
    assert {r.doc_id: r.text for r in back.collect()} == {i: got[i].decoded for i in got}
    assert sentencepiece_codec.round_trip_texts(none, MODEL).count() == 0


def test_models_that_break_the_assumptions_are_refused(monkeypatch):
    class Other(sentencepiece.SentencePieceProcessor):
        def normalize(self, x):
            return x.lower()

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError, match="normalises"):
        sentencepiece_codec.load_vocabulary(MODEL)


# 3 -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 70), (1, 50)])
def test_components_of_awkward_rows(spark, docs, none, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(docs, shingle=k, percent=percent).collect()}
    assert got == brute.components(DOCS, k, percent)
    assert jaccard_join.join_components(none).count() == 0


def test_one_id_of_two_texts(spark):
    long = TEXTS[16]
    rows = [(1, SAID), (9, SAID), (9, long), (12, long + " end")]
    got = [(r.doc_id, r.component_id) for r in jaccard_join.join_components(_docs(spark, rows)).collect()]
    assert sorted(got) == [(1, 1), (9, 1), (9, 9), (12, 9)]


def _mutants(seed):
    """Groups of mutated copies with a shared passage, of many sizes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, rows = [word() for _ in range(30)], []
    for size in (6, 9, 15, 30, 60, 150, 400):
        base = [word() for _ in range(size)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(1 + size // 8)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join((passage if rng.random() < 0.4 else []) + w))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "k", "percent", "small"), [(1, 4, 85, False), (2, 5, 80, True), (3, 2, 60, False), (4, 3, 50, True)])
def test_components_of_mutants(spark, monkeypatch, seed, k, percent, small):
    """small: every block is too large for its pairs, every key is hot, no table is small."""
    rows = _mutants(seed)
    monkeypatch.setattr(jaccard_join, "HOT_TEXTS", 6)
    if small:
        for name, value in {"BROADCAST_ROWS": 10, "BLOCK_ROWS": 2, "CELL_ROWS": 2, "HOT_KEY": 1 / 300, "HOT_ROWS": 1, "SALTS": 3}.items():
            monkeypatch.setattr(jaccard_join, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(_docs(spark, rows), shingle=k, percent=percent).collect()}
    assert got == brute.components(rows, k, percent)


def test_null_and_repeated_ids_take_part(spark):
    """Links among rows without id, and copies without id of rows that have one."""
    long, other = TEXTS[16], " ".join(f"u{i}" for i in range(300))
    rows = [(None, long), (None, long + " end"), (None, None), (None, ""), (5, other + " end"), (None, other), (None, other), (7, other), (7, "x y"), (3, "x y")]
    got = jaccard_join.join_components(_docs(spark, rows)).collect()
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    want = [(None, 1997, None), (None, 1998, None), (None, 0, None), (None, 0, None), (5, 298, 5), (None, 297, 5), (None, 297, 5), (7, 297, 5), (7, 1, 3), (3, 1, 3)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(11)
    for t in range(600):
        percent, n = (85, 80, 50)[t % 3], int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.integers(0, 1 + n // 4) :], rng.integers(0, 2**64, int(rng.integers(0, 1 + n // 4)), dtype=np.uint64)]))
        both = np.intersect1d(a, b)
        every = np.union1d(a, b)
        if 100 * len(both) < percent * len(every):
            continue
        hashes = every[rng.random(len(every)) < rng.choice([0, 0.5, 1])]
        hot = jaccard_join.Hot(hashes, rng.permutation(len(hashes)))
        assert len(np.intersect1d(jaccard_join.prefix_of(a, hot, percent), jaccard_join.prefix_of(b, hot, percent)))


def test_scratch_is_cleared(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(spark.conf, "get", lambda *a, get=spark.conf.get: f"file://{tmp_path}" if a[0] == "spark.checkpoint.dir" else get(*a), raising=False)
    assert jaccard_join.join_components(docs).count() == len(DOCS)
    (left,) = (tmp_path / "serion").iterdir()
    assert [x.name for x in left.iterdir()] == ["result"]


def test_no_link_misses_a_key():
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 2**64, int(n), dtype=np.uint64)
    tried = 0
    for t in range(1500):
        percent, n = (85, 80)[t % 2], int(rng.choice([5, 7, 9, 14, 20, 33, 50, 80, 200, 600]))
        a = np.unique(draw(n))
        b = np.unique(np.concatenate([a[rng.integers(0, 2 + n // 5) :], draw(rng.integers(0, 2 + n // 8))]))
        shared = len(np.intersect1d(a, b))
        if shared == len(a) == len(b) or 100 * shared < percent * (len(a) + len(b) - shared):
            continue
        hot = np.unique(np.concatenate([a, b])[rng.random(len(a) + len(b)) < rng.choice([0, 0.3, 0.5, 0.8, 1])])
        keys = [jaccard_join.keys_of(x, jaccard_join._is_hot(x, hot), percent) for x in (a, b)]
        assert len(np.intersect1d(*keys))
        tried += 1
    assert tried > 300


def test_representatives(spark):
    rows = [*DOCS, (6, SAID), (12, TEXTS[12])]
    got = jaccard_join.keep_representatives(_docs(spark, rows), shingle=5, percent=80)
    want = brute.components(DOCS, 5, 80)
    assert got.columns == _docs(spark, []).columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i in want if want[i][1] == i)


def test_representatives_of_repeated_and_null_ids(spark):
    long, alone = TEXTS[16], " ".join(f"v{i}" for i in range(300))
    rows = [(1, SAID), (9, SAID), (9, long), (9, alone), (9, alone.upper()), (12, long + " end"), (None, SAID), (None, "null " + alone)]
    rows += [(None, t) for t in (" ".join(f"u{i}" for i in range(300)), " ".join(f"u{i}" for i in range(299)))] + [(None, None), (None, ""), (20, "one of its own")]
    got = [(r.doc_id, (r.text or "").lower()[:3]) for r in jaccard_join.keep_representatives(_docs(spark, rows)).collect()]
    want = [(1, "the"), (9, "w0 "), (9, "v0 "), (None, "u0 "), (None, ""), (None, ""), (20, "one")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_representatives_row_by_row(spark):
    long, x, y = TEXTS[16], " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    rows = [(1, SAID), (9, SAID), (9, long), (12, long + " end"), (20, x), (20, y), (30, None), (30, "")]
    got = sorted(((r.doc_id, r.text) for r in jaccard_join.keep_representatives(_docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, SAID), (9, long), (20, x), (20, y), (30, None), (30, "")], key=str)


def test_joined_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in q.op3_jaccard_join(spark, SF).collect()}
    assert got == brute.components(rows, 4, 85)


# 4 -------------------------------------------------------------------------------------------------


def test_language(spark, docs, none):
    got = {r.doc_id: r for r in q.op4_language_id(spark, SF).collect()}
    rows = table(spark, SF, "documents").collect()
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.9 * len(held)
    net = language_id.learn(table(spark, SF, "documents"))
    told = {r.doc_id: r.language for r in language_id.with_language(docs, net).collect()}
    for i, t in DOCS:
        letters = any(c.isalpha() for c in t or "")
        assert (told[i].lang_pred == "und") == (not letters) and 0 <= told[i].score <= 1
        lang, score = brute.language(net, t)
        assert told[i].lang_pred == lang and abs(told[i].score - score) < 1e-4
    plain = [(r.doc_id, *brute.language(net, r.text)) for r in rows[:25]]
    again = {r.doc_id: r.language for r in language_id.with_language(table(spark, SF, "documents"), net).collect()}
    assert all(again[i].lang_pred == lang and abs(again[i].score - score) < 1e-4 for i, lang, score in plain)
    nameless = language_id.learn(table(spark, SF, "documents").withColumn("doc_id", F.lit(None).cast("long")))
    assert nameless.langs == net.langs
    assert spark.createDataFrame([(None,)], "i long").select(language_id.held_out(F.col("i"))).first()[0] is None
    assert language_id.learn(none) is None
    assert language_id.learn(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.language.lang_pred for r in language_id.with_language(docs, None).collect()} == {"und"}
    assert language_id.with_language(none, net).count() == 0
    assert language_id.keep_recognised(docs).columns == docs.columns


# 5 -------------------------------------------------------------------------------------------------


def _measures(r):
    m = r.quality
    return m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed


def test_quality(spark, docs, none):
    rng = random.Random(4)
    rows = [*TEXTS, *[" ".join(rng.choice("ab") for _ in range(n)) for n in range(30)], "a b c d e f g h " * 3, " ".join("abcdefgh") + " x " + " ".join("abcdefgh")]
    rows += [r.text for r in table(spark, SF, "documents").collect()]
    got = {r.doc_id: r for r in quality_rules.with_quality(_docs(spark, list(enumerate(rows)))).collect()}
    for i, t in enumerate(rows):
        assert _measures(got[i]) == brute.quality(t), t[:80]
        assert not (got[i].quality.kept and got[i].quality.base_failed)
    assert quality_rules.keep_good(none).count() == 0
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_stop_words_with_marks(spark):
    rows = [(1, "zork blim. " * 2 + " ".join(f"word{i}" for i in range(20)) + " (The."), (2, " ".join(f"word{i}" for i in range(24)))]
    got = {r.doc_id: r.quality for r in quality_rules.with_quality(_docs(spark, rows)).collect()}
    assert (got[1].n_stop_words, got[1].kept, got[2].n_stop_words, got[2].kept) == (1, True, 0, False)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Awkward documents, pages and conversations as tables."""
    path = str(tmp_path_factory.mktemp("tables"))
    marked = ["zork blim. " * 2 + " ".join(f"word{i}" for i in range(20)) + " (The.", " ".join("«the» „und“ Zork," for _ in range(9)), "THE! of? " + " ".join(f"v{i}" for i in range(40)), "„Der“ word " * 12]
    _docs(spark, [*DOCS, *enumerate(marked, 100), *[(r.doc_id + 1000, r.text) for r in table(spark, SF, "documents").limit(300).collect()]]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, "http://a.cheap-pills.example.net/de/", "http://cheap-pills.example.com/fr/x"])], "page_id long, url string").write.parquet(f"{path}/pages.parquet")
    said = [(c, t, r, x) for c in range(9) for t, r, x in [(0, "system", "be: brief"), (1, "user", None), (1, "user", "\\# a"), (2, "assistant", "</turn> ok"), (3, None, "x")][c % 4 :]]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_queries_are_their_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = q.QUERIES[name](spark, folder)
    r = con.execute(oracles.ORACLES[name])
    names = sorted(df.columns)
    at = {x[0]: k for k, x in enumerate(r.description)}
    assert sorted(at) == names
    assert sorted(str([x[at[c]] for c in names]) for x in r.fetchall()) == sorted(str([x[c] for c in names]) for x in df.collect())


def test_quality_is_native(spark):
    plan = q.op5_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    plan += q.op9_chat_format(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 6 -------------------------------------------------------------------------------------------------


URLS = [None, "", "no scheme", "http://A.Example.ORG", "http://x.example.org/es/1?q#f", "https://y.org/a", "http://z.com/fr/", "http://z.com/de/?", "ftp://spam-farm.example.org.evil.net/x", "http://www.spam-farm.example.com/x", "http://spam-farm.example.org", "a://b://c", "http://host?x=/p", "http://ß.com/fr/#/de/", "http://www.spam-farm.example.com/x", "http://elsewhere.net./", "http://a..elsewhere.net/"]


def _judged(spark, urls, hosts):
    pages = spark.createDataFrame([(i, u, "x", "y", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, key int")
    got = url_filters.judge_urls(pages, spark.createDataFrame([(h,) for h in hosts], "host string"))
    assert got.columns == [*pages.columns, "url_filter"]
    return {r.page_id: r.url_filter for r in got.collect()}


def test_urls(spark):
    got = _judged(spark, URLS, ["Spam-farm.example.com", "spam-farm.example.org", None, "", "elsewhere.net", "elsewhere.net"])
    assert [(got[i].host, got[i].path) for i in (0, 2, 3, 11, 12)] == [("", ""), ("", ""), ("a.example.org", ""), ("b:", "//c"), ("host", "")]
    assert [(got[i].rule, got[i].verdict) for i in (4, 5, 6, 7)] == [("example.org/es/", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block")]
    assert [got[i].verdict for i in (0, 1, 2, 3, 8, 9, 10, 13, 14, 15, 16)] == ["allow", "allow", "allow", "allow", "allow", "block", "block", "allow", "block", "allow", "block"]
    assert {x.verdict for x in _judged(spark, URLS[8:10], []).values()} == {"allow"}
    assert _judged(spark, [], ["a.b"]) == {}


@pytest.mark.parametrize(("range_keys", "pass_bytes"), [(10**6, 1 << 26), (700, 1 << 26), (80, 1), (80, 4000)])
def test_any_number_of_ranges_and_passes(spark, monkeypatch, range_keys, pass_bytes):
    monkeypatch.setattr(url_filters, "RANGE_KEYS", range_keys)
    monkeypatch.setattr(url_filters, "PASS_BYTES", max(pass_bytes, 1))
    rng = random.Random(6)
    hosts = [".".join(rng.choice("abcdefghijkl") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 5))) for _ in range(1500)]
    listed = set(rng.sample(hosts, 12)) - set("abcdefghijkl")
    got = _judged(spark, ["x://" + h for h in hosts], sorted(listed))
    parents = lambda h: {h.split(".", k)[k] for k in range(h.count(".") + 1)}
    assert [got[i].listed for i in range(len(hosts))] == [bool(parents(h) & listed) for h in hosts]


def test_long_hosts_take_linear_time(spark):
    long = ".".join(["ab"] * 60_000)
    got = _judged(spark, ["http://" + long + ".evil.net", "http://" + long + ".good.net", "http://" + "x" * 10**6], ["evil.net"])
    assert [got[i].verdict for i in range(3)] == ["block", "allow", "allow"]


def test_cascade_is_exact():
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(0, 2**64, 20000, dtype=np.uint64))
    for share in (0.0, 0.001, 0.05, 0.6, 1.0):
        listed = keys[rng.random(len(keys)) < share]
        levels = url_filters.build_cascade(keys, listed)
        assert np.array_equal(url_filters.listed_by(levels, keys), np.isin(keys, listed))
        assert len(levels) > 1 or share in (0.0, 0.001, 1.0)


# 7 -------------------------------------------------------------------------------------------------


def test_classifier(spark, docs, none):
    all_docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    graded = labels.select("doc_id", quality_classifier.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    model = quality_classifier.learn(all_docs, graded.where("doc_id % 3 != 0"))
    assert (np.diff(model.thresholds) >= 0).all()
    got = quality_classifier.with_grade(all_docs, model, out="g").join(graded.where("doc_id % 3 = 0"), "doc_id").collect()
    right = [r.g.selected == (r.grade == 2) for r in got]
    assert sum(right) >= 0.85 * len(right)
    assert all(1 >= r.g.tails[0] >= r.g.tails[1] >= 0 and abs(sum(r.g.tails) - r.g.expected_grade) < 1e-9 for r in got)
    assert len(quality_classifier.with_grade(docs, model, out="key").collect()) == len(DOCS)
    assert quality_classifier.with_grade(none, model).count() == 0
    empty = quality_classifier.learn(docs, graded.limit(0))
    assert {r.grade.expected_grade for r in quality_classifier.with_grade(docs, empty).collect()} == {1.0}


def test_ordinal_gradient_is_the_slope():
    """The likelihood told in plain Python, and the gradient against differences of it."""
    rng = np.random.default_rng(8)
    n, m = 40, 9
    grades = rng.integers(0, 3, n)
    rows = [np.flatnonzero(rng.random(m) < 0.4) for _ in range(n)]
    at, text = np.concatenate(rows), np.repeat(np.arange(n), [len(x) for x in rows])
    w, t = rng.normal(size=m), np.array([-0.3, 0.8])

    def loss(w, t):
        total = 0.0
        for x, g in zip(rows, grades, strict=True):
            tails = [1.0, *(1 / (1 + np.exp(k - w[x].sum())) for k in t), 0.0]
            total -= np.log(tails[g] - tails[g + 1])
        return total / n

    got, g, g_t = quality_classifier.loss_and_gradient(w, t, at, text, grades)
    assert abs(got - loss(w, t)) < 1e-12
    step = lambda k, size: np.eye(size)[k] * 1e-6
    assert np.allclose(g, [(loss(w + step(k, m), t) - loss(w - step(k, m), t)) / 2e-6 for k in range(m)], atol=1e-7)
    assert np.allclose(g_t, [(loss(w, t + step(k, 2)) - loss(w, t - step(k, 2))) / 2e-6 for k in range(2)], atol=1e-7)


def test_grades_are_brute_force(spark):
    rng = np.random.default_rng(9)
    model = quality_classifier.Ordinal(rng.normal(0, 0.3, 1 << quality_classifier.BITS).astype(np.float32), np.array([-0.5, 1.0]))
    rows = [*DOCS, *[(r.doc_id + 1000, r.text) for r in table(spark, SF, "documents").limit(60).collect()], (None, SAID), (None, None)]
    got = quality_classifier.with_grade(_docs(spark, rows), model).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute.grade_tails(model, r.text)
        assert np.allclose(r.grade.tails, want, atol=1e-6) and abs(r.grade.expected_grade - sum(want)) < 1e-6
        assert r.grade.selected == (r.grade.tails[-1] >= quality_classifier.LEAST_TAIL)
    labels = spark.createDataFrame([(None, 2), (None, None), (1, None)], "doc_id long, grade int")
    assert not quality_classifier.learn(_docs(spark, rows), labels).weights.any()


def test_ordinal_gradient_learns_order():
    rng = np.random.default_rng(7)
    grades = rng.integers(0, 3, 600)
    rows = [np.unique(np.append(rng.integers(100, 140, 5), 10 + g)) for g in grades]
    model = quality_classifier.fit(rows, grades)
    assert model.weights[10] < model.weights[11] < model.weights[12]
    tails = model.tails(np.array([model.weights[x].sum() for x in rows]))
    assert ((tails > 0.5).sum(1) == grades).mean() > 0.95


# 8 -------------------------------------------------------------------------------------------------

ITEMS = [("1", SAID), ("2", None), ("3", ""), ("4", "one two"), ("5", "!!"), ("6", SAID.upper()), ("6", "w10 w11"), (None, "w3 w4")]


def _found(df):
    return {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in df.collect()}


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_contamination(spark, monkeypatch, docs, none, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    named = [x for x in ITEMS if x[0] is not None]  # those without id have a test of their own
    items = spark.createDataFrame(named, "item_id string, text string")
    want = brute.contamination([t for _, t in DOCS], named)
    assert _found(decontaminate.decontaminate(docs, items)) == dict(enumerate(want))
    assert decontaminate.decontaminate(none, items).count() == 0
    assert {x[1] for x in _found(decontaminate.decontaminate(docs, items.limit(0))).values()} == {0}
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, (n, h, _) in enumerate(want) if not (h and 20 * h >= n)]


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_contamination_by_items_without_id(spark, monkeypatch, docs, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    more = [*ITEMS, (None, "w10 w11 w12")]
    last = "\uffff"
    want = [(n, h, [None if i == last else i for i in found]) for n, h, found in brute.contamination([t for _, t in DOCS], [(last if i is None else i, t) for i, t in more])]
    assert ["6", None] in [found for _, _, found in want]
    found = decontaminate.decontaminate(docs, spark.createDataFrame(more, "item_id string, text string"))
    assert _found(found) == dict(enumerate(want))


def test_contamination_over_shards(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 3000)
    rows, test = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = _found(decontaminate.decontaminate(rows, test))
    texts = rows.collect()
    want = brute.contamination([r.text for r in texts], [(str(r.item_id), r.text) for r in test.collect()])
    assert got == {r.doc_id: w for r, w in zip(texts, want, strict=True)}


@pytest.mark.parametrize(("candidates", "block"), [(1 << 18, 16 << 20), (7, 16 << 20), (50, 900)])
def test_contamination_of_few_words(spark, monkeypatch, candidates, block):
    """Texts of a tiny vocabulary: many places per term, overlapping and repeated windows; one index, two test tables."""
    monkeypatch.setattr(decontaminate, "CANDIDATES", candidates)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(12)
    said = lambda n, words: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, said(rng.randrange(60), "a a a b c".split())) for i in range(80)] + [(80, "a " * 500), (80, "a " * 40), (None, "b c " * 30), (81, None)]
    index = decontaminate.Scratch(spark, "t").save("index", decontaminate.build_index(_docs(spark, rows).coalesce(2)))
    for items in ([(str(i), said(rng.randrange(1, 18), "a b c d".split())) for i in range(60)], [("x", "a " * 13), ("y", "b c " * 8), ("z", "a"), ("w", rows[7][1])]):
        got = decontaminate.search_table(index, spark.createDataFrame(items, "item_id string, text string")).collect()
        want = brute.contamination([t for _, t in rows], items)
        key = lambda x: str(x)
        assert sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in got), key=key) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=key)
        assert all(r.n_hit == len({k for a, z in zip(r.span_start, r.span_end, strict=True) for k in range(a, z)}) for r in got)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta x gamma x delta"), (2, "delta gamma beta alpha"), (3, "alpha " + "x " * 200 + "beta gamma delta")], "doc_id long, text string")
    test = spark.createDataFrame([("i", "alpha beta gamma delta")], "item_id string, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in decontaminate.decontaminate(docs, test).collect()}
    assert got == {1: ([], ["i"]), 2: ([], ["i"]), 3: ([], [])}


def test_proximity_ends_with_the_document(spark):
    rows = [(1, "alpha x beta x gamma x delta"), (2, "delta gamma beta alpha"), (3, "alpha " + "x " * 200 + "beta gamma delta"), (4, "alpha"), (5, ""), (6, "beta gamma"), (7, "delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    test = spark.createDataFrame([("i", "alpha beta gamma delta")], "item_id string, text string")
    got = {r.doc_id: r.near_items for r in decontaminate.decontaminate(docs, test).collect()}
    assert got == {1: ["i"], 2: ["i"], 3: [], 4: [], 5: [], 6: [], 7: []}


# 9 -------------------------------------------------------------------------------------------------

_CONTROL = st.lists(st.sampled_from(["\\", "<", "#", "</turn>\n", "### ", ": ", "\n", "0", "1", "2", "3", "a"]), max_size=12).map("".join)


def test_chats_round_trip(spark):
    rng = random.Random(8)
    bits = ["\\", "<", "#", "</turn>\n", "### ", ": ", "\n", "0", "1", "2", "3", "a", "é🤖", " "]
    said = lambda: None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a: b", None]), said(), "x") for c in [*range(60), None] for t in range(rng.randrange(1, 6))]
    rows += [(99, 0, "user", "twice", "x")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    got = chat_format.format_chats(df).withColumn("read", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("segments"))).collect()
    assert len(got) == 62
    for g in got:
        turns = sorted((t, r or "", x or "") for c, t, r, x, _ in rows if c == g.conv_id)
        assert [(x.role, x.text) for x in g.read] == [(r, x) for _, r, x in turns]
        assert g.loss == "".join(x for _, r, x in turns if r == "assistant")
    assert chat_format.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize(("roles", "fine"), [(["user", "assistant"], True), (["system", "user", "assistant", "user", "assistant"], True), (["user"], False), (["assistant", "user"], False), (["user", "user"], False), (["system"], False), (["user", "tool"], False), (["user", None], False)])
def test_turn_order(spark, roles, fine):
    df = spark.createDataFrame([(1, k, r, "x") for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    assert chat_format.format_chats(df).first().valid == fine


# 10 ------------------------------------------------------------------------------------------------


def _close(got, rows):
    want = brute.base_scores(rows)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for (i, _), (n, known, total, base) in zip(rows, want, strict=True):
        for r in by[i]:
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(i).encode()) % 5 == 1)
            assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
            assert r.score <= 1e-9


@pytest.mark.parametrize("own", [5, 1 << 12])
def test_scores_are_brute_force(spark, monkeypatch, own):
    """Scores of whole texts, null ids too: plain forward recursion with the trained parameters."""
    monkeypatch.setattr(lm_scoring, "OWN", own)
    rows = [*DOCS, *[(r.doc_id + 1000, r.text) for r in table(spark, SF, "documents").limit(40).collect()], (None, SAID + " again"), (None, None)]
    df = _docs(spark, rows)
    counted = lm_scoring.Scratch(spark, "t").save("counts", lm_scoring.token_counts(df, "doc_id", "text"))
    counts = lm_scoring.summarise(counted)
    model = lm_scoring.train(lm_scoring.encode(df, counts, "doc_id", "text"), counts, 2)
    got = lm_scoring.score_texts(df, rounds=2).collect()
    assert [r.held_out for r in got if r.doc_id is None] == [False, False]
    want = [(str(i), n, round(x, 6)) for (i, _), x, (n, *_) in zip(rows, brute.model_scores(model, rows), brute.base_scores(rows), strict=True)]
    for a, b in zip(sorted((str(r.doc_id), r.n_tokens, r.score) for r in got), sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 * max(1, abs(b[2]))


def test_scores(spark, docs, none, monkeypatch):
    _close(lm_scoring.score_texts(docs, rounds=1).collect(), DOCS)
    monkeypatch.setattr(lm_scoring, "FREQUENT", 3)
    monkeypatch.setattr(lm_scoring, "GATHER", 5)
    monkeypatch.setattr(lm_scoring, "STEP_TOKENS", 40)
    _close(lm_scoring.score_texts(docs, rounds=1).collect(), DOCS)
    assert lm_scoring.score_texts(none, rounds=1).count() == 0


def test_scores_of_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = q.op10_lm_scoring(spark, SF).collect()
    _close(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # states help on unseen texts


def test_likelihood_is_exact():
    rng = np.random.default_rng(9)
    s = lm_scoring.STATES
    model = lm_scoring.Model(rng.dirichlet(np.ones(s)), rng.dirichlet(np.ones(s), s), rng.dirichlet(np.ones(lm_scoring.CLASSES), s).T)
    texts = [rng.integers(0, lm_scoring.CLASSES, n).astype(np.uint16) for n in (1, 2, 16, 17, 255, 256, 257, 1030)]
    for x, got in zip(texts, lm_scoring.log_likelihoods(model, texts), strict=True):
        a, want = model.start * model.emit[x[0]], 0.0
        for t in x[1:]:
            want, a = want + np.log10(a.sum()), (a / a.sum() @ model.move) * model.emit[t]
        assert abs(want + np.log10(a.sum()) - got) < 1e-8 * len(x) + 1e-9
    starts, moves, emits = lm_scoring.expected_counts(model, texts)
    assert abs(emits.sum() - sum(map(len, texts))) < 1e-6 and abs(starts.sum() + moves.sum() - emits.sum()) < 1e-6
