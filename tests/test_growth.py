"""Steps that have to be done once for each text or line, whatever a table's size, told from their plans."""

from pyspark.sql import functions as F

from leafline import page_queries
from leafline.functions import text
from leafline.operators import evaluate, matching, reports, session
from leafline.plans import judge


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stop_words_are_a_set(spark):
    docs = spark.createDataFrame([("the ward and a bed",), (None,)], "t string")
    for found in (text.tokenize("t"), text.key_words(F.coalesce("t", F.lit("")))):
        out = docs.select(found.alias("w"))
        assert "INSET" in _plan(out) and [r.w for r in out.collect()] == [["ward", "bed"], []]


def test_sentence_scores_agree_with_brute_force():
    asked = ["12 1.5 beds bed ward", "", "ard 2 the"]
    said = "12 beds. a wards; 1.5: none 112.55 Bed-ward.\nthe rest; .5 2"
    split = ["12 beds.", "a wards;", "1.5:", "none 112.55 Bed-ward.", "the rest;", ".5 2"]
    expected = []
    for q in asked:
        scores = [sum(5 if p[0].isdigit() else 1 for p in q.split() if p in s) + 2 * any(c.isdigit() for c in s) for s in split]
        expected.append((max(scores), scores.index(max(scores))))
    assert [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in reports._Questions("\n".join(asked)).best(said)] == expected


def test_mentions_read_the_documents_once(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "b"]), (2, ["c"])], "doc_id int, h array<string>")
    items = spark.createDataFrame([(1, ["a", "x"]), (1, ["a", "b", "c"]), (2, [])], "item_id int, n array<string>")
    out = matching.mentioned(docs, items)
    assert _plan(out).count("LogicalRDD") + _plan(out).count("LocalRelation") == 1
    assert sorted(map(tuple, out.collect())) == [(1, 1)] * 4


def test_forced_answers_move_a_text_once(spark):
    queries = spark.createDataFrame([(1, "ward beds")], "id int, query string")
    drawn = spark.createDataFrame([(1, 0, "d", 5)], "id int, nth int, doc_id string, leaf_id int")
    leaves = spark.createDataFrame([("d", 5, "beds in a ward")], "doc_id string, leaf_id int, text string")
    out = evaluate.forced_answers(queries, drawn, leaves, judge.lexical_judge())
    first = next(line for line in _plan(out).splitlines() if "Join" in line)
    assert "leaf_id" in first and out.first()["n_relevant"] == 1


def test_session_pieces_are_made_once(spark):
    kind = "doc_id int, region_no int, type string, text string, page int, x0 double, y0 double, x1 double, y1 double, level int"
    regions = spark.createDataFrame([(1, 1, "paragraph_title", "A", 0, 0.0, 0.0, 1.0, 1.0, 1), (1, 2, "text", "b", 0, 0.0, 1.0, 1.0, 2.0, None)], kind)
    assets = "doc_id int, region_no int, asset_id string, type string, number int, caption string, image string, description string, table_markdown string, is_icon boolean"
    out = session.session_markdown(regions, spark.createDataFrame([], assets))
    assert "LogicalRDD" not in _plan(out) and "LocalRelation" not in _plan(out)
    assert out.first()["markdown"].startswith("# A\n\n```pin\nid: a\n")


def test_index_stream_parses_a_page_once(spark, monkeypatch):
    parsed = spark.sparkContext.accumulator(0)

    def parse(t):
        parsed.add(1)
        return t

    docs = spark.createDataFrame([(i, f"# p{i}") for i in range(20)], "doc_id long, text string")
    drained = type("Drained", (), {"awaitTermination": lambda self: True})()
    rows = "doc_id long, node_seq int, node_id string, parent_seq int, title string, is_leaf boolean, depth int, summary string, content_hash string"
    monkeypatch.setattr(page_queries, "page_docs", lambda spark, _: docs.withColumn("text", F.udf(parse, "string")("text")))
    monkeypatch.setattr(page_queries.maintain, "maintain", lambda *_: drained)
    monkeypatch.setattr(page_queries.maintain.IndexStore, "read", lambda self: spark.createDataFrame([], rows))
    page_queries.index_stream(spark, "none")
    assert parsed.value == 20
