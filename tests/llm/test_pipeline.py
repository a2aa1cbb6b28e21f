"""run() of the pipeline against plain Python versions of its five stages, stage by stage and as a whole."""

import pytest
import sentencepiece

import corpus_pipeline
from serion.llm import language_id, quality_rules
from serion.llm.queries import tokenizer_path
from serion.llm.storage import table
from tests.llm import brute
from tests.llm.test_operators import DOCS

SF = "/root/testdata/sf0.001"


def good(t):
    """The verdict of the quality rules."""
    n, chars, symbols, repeated, _, failed = brute.quality(t)
    if failed:
        return False
    stop = sum(w.lower().strip(quality_rules.MARKS) in quality_rules.STOP_WORDS for w in brute.WORD.findall(t))
    lines = sum(bool(brute.WORD.search(x)) for x in t.split("\n"))
    return 2 <= chars / n <= 12 and symbols / n <= 0.1 and stop / n >= 0.04 and repeated / lines <= 0.5


def told(net, t):
    """Whether the network recognises the language."""
    lang, score = brute.language(net, t)
    return lang != "und" and score >= language_id.LEAST_SCORE


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, awkward rows, a copy, a near copy, a contaminated text and null columns."""
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    rows = [tuple(r) for r in docs.collect()]
    clean = next(r.text for r in docs.collect() if good(r.text) and len(r.text.split()) > 150)
    passage = next(r.text for r in items.collect() if len((r.text or "").split()) >= 20)
    words = clean.split()
    more = [t for _, t in DOCS] + [clean, " ".join(words[:-3] + ["other"]), clean[: len(clean) // 3] + "\n" + passage]
    rows += [(100_000 + k, t, None, None, None) for k, t in enumerate(more)]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{path}/documents.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_is_brute_force(spark, folder):
    items = [(str(r.item_id), r.text) for r in table(spark, folder, "benchmark").collect()]
    source = table(spark, folder, "documents")
    left = {r.doc_id: r.text for r in source.collect()}
    sizes = [len(left)]
    want = {i: t for i, t in left.items() if good(t)}
    net = language_id.learn(source.where(source.doc_id.isin(*want)).where(~language_id.held_out(source.doc_id)))
    sizes.append(len(want))
    want = {i: t for i, t in want.items() if told(net, t)}
    sizes.append(len(want))
    groups = brute.components(list(want.items()), 5, 80)
    want = {i: t for i, t in want.items() if groups[i][1] == i}
    sizes.append(len(want))
    hits = dict(zip(want, brute.contamination(want.values(), items), strict=True))
    want = {i: t for i, t in want.items() if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])}
    sizes.append(len(want))
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > sizes[4] > 50
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    got = {r.doc_id: (r.n_tokens, r.ids_text, r.decoded) for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(want)
    for i, t in want.items():
        ids = library.encode(t, add_eos=True)
        assert got[i] == (len(ids), " ".join(map(str, ids)), library.decode(ids))


def test_stages_keep_the_columns(spark, folder):
    docs = table(spark, folder, "documents")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema.names == docs.schema.names


def test_run_over_no_documents(spark, folder, tmp_path):
    table(spark, folder, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, folder, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
