"""Pipeline stages on tables whose columns bear the names that stages would use."""

from serion.llm import jaccard_join, language_id, quality_rules
from tests.llm.test_operators import _docs

GOOD = "the quick brown fox and the lazy dog went to the river with a few of their friends that day and it was a good day for all of them"


def test_stages_keep_columns_whatever_their_names(spark):
    rows = [(1, GOOD), (2, GOOD + " again"), (3, None), (None, GOOD)]
    docs = _docs(spark, rows).withColumnsRenamed({"source": "quality", "n_chars": "language", "label": "row"})
    for stage in (quality_rules.keep_good, language_id.keep_recognised, jaccard_join.keep_representatives):
        kept = stage(docs)
        assert kept.columns == docs.columns
        assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}
        assert kept.where("doc_id = 1").count() == 1


def test_rare_languages_and_long_texts(spark, monkeypatch):
    """A sample is bounded in languages and windows, and takes windows of the whole text."""
    monkeypatch.setattr(language_id, "LEAST_SHARE", 0.2)
    monkeypatch.setattr(language_id, "LEARN_WINDOWS", 4)
    monkeypatch.setattr(language_id, "EPOCHS", 1)
    seen = {}
    fit = language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda w, y, t, langs: seen.update(w=w, y=y, t=t, langs=langs) or fit(w, y, t, langs))
    rows = [(i, "abc " * 3000 + "end", "en") for i in range(5)] + [(9, "x", "de"), (10, "y z", "fr"), (11, "", "fr"), (12, "w", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.learn(docs) is not None
    assert seen["langs"] == ["en", "fr"]
    assert sorted(map(int, __import__("numpy").bincount(seen["t"]))) == [1, 1, 4, 4, 4, 4, 4]
    assert language_id.learn(docs.limit(0)) is None
