from leafline import config, registry
from leafline.operators import matching, tree


def test_names_match_documents(spark):
    docs = spark.createDataFrame([("kb_report_2020",), ("other",)], "doc_id string")
    named = spark.createDataFrame([("Report 2020",), ("x",), ("OTHER",)], "name string")
    got = {r.name: r.doc_id for r in matching.match_documents(named, docs).collect()}
    assert got == {"Report 2020": "kb_report_2020", "x": None, "OTHER": "other"}


def test_returned_ids_are_scored(spark):
    returned = spark.createDataFrame(
        [(1, 0, "C9", "?"), (1, 1, "C1", "The  “quote”"), (1, 2, "C1", "again")], "query_id int, pos int, chunk_id string, quote string"
    )
    chunks = spark.createDataFrame([("C1", "d", 'Has the "quote" here')], "chunk_id string, doc string, body string")
    gold = spark.createDataFrame([(1, "C1", "d")], "query_id int, chunk_id string, doc string")
    scored = matching.scored_ids(returned, chunks, gold)
    by = {r.chunk_id: r for r in scored.collect()}
    assert by["C1"].verbatim and by["C1"].is_gold and by["C9"].verbatim is None and not by["C9"].known
    assert matching.gold_rank(scored).first()["rank"] == 2


def test_gold_map(spark):
    docs = spark.createDataFrame([("d", "# A\nprose\n## B\nx")], "doc_id string, text string")
    pins = spark.createDataFrame([("d", "L1", "a"), ("d", "L2", "b")], "doc_id string, label string, node_id string")
    queries = spark.createDataFrame(
        [(1, "L1", "d", "a"), (2, "L2", "d", "a"), (3, "L3", "d", "b")], "query_id int, label string, doc_id string, node_id string"
    )
    got = {r.query_id: r for r in matching.gold_map(pins, queries, tree.nodes(docs)).collect()}
    assert got[1].target_leaf == "a-overview" and got[1].section_level and got[1].problem is None
    assert got[2].problem == "pin disagrees with query" and got[3].problem == "label has no pin"


def test_settings_and_registry(tmp_path):
    settings = config.Settings().updated({"answer_context": 10, "max_evals": None, "unknown": 1})
    assert settings.answer_context == config.CONTEXT_LEAST and settings.max_evals == 400
    config.save(settings, tmp_path / "s.json")
    assert config.load(tmp_path / "s.json") == settings and config.load(tmp_path / "none.json") == config.Settings()

    @registry.stage("index", "plain")
    def plain(df):
        return df

    assert registry.load("index", "plain") is plain and [e.name for e in registry.stages("index")] == ["plain"]
