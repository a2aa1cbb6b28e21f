"""Operator 8: many items of one text, many distinct ones, and columns whose names clash."""

from serion.llm import decontaminate
from tests.llm.test_operators import _docs

SAID = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_items_of_one_text_are_searched_once(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)
    read, sizes = decontaminate.Items.read, []
    monkeypatch.setattr(decontaminate.Items, "read", staticmethod(lambda t: sizes.append(read(t)) or sizes[-1]))
    items = spark.range(3000).selectExpr("cast(id AS string) AS item_id", f"'{SAID}' AS text")
    docs = _docs(spark, [(1, "so " + SAID + " end"), (2, "other words"), (3, None)])
    got = {r.doc_id: (r.n_hit, len(r["items"]), r["items"][:2]) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: (14, 3000, ["0", "1"]), 2: (0, 0, []), 3: (0, 0, [])}
    assert [len(x.numbers) for x in sizes] == [1]


def test_distinct_items_go_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)
    read, sizes = decontaminate.Items.read, []
    monkeypatch.setattr(decontaminate.Items, "read", staticmethod(lambda t: sizes.append(read(t)) or sizes[-1]))
    items = spark.range(300).selectExpr("cast(id AS string) AS item_id", "concat('w', id, ' v', id, ' u', id) AS text")
    docs = _docs(spark, [(i, f"a w{i} v{i} u{i} b") for i in range(0, 300, 7)])
    assert {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.decontaminate(docs, items).collect()} == {i: (3, [str(i)]) for i in range(0, 300, 7)}
    assert len(sizes) > 4
    assert max(len(x.numbers) for x in sizes) < 100


def test_clean_rows_keep_all_columns(spark):
    docs = _docs(spark, [(1, SAID), (2, "clean")]).withColumnsRenamed({"lang": "_row", "source": "_serion_row"})
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame([("i", SAID)], "item_id string, text string"))
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == [tuple(r) for r in docs.where("doc_id = 2").collect()]
