import json

import pytest
from pyspark.sql import functions as F

from leafline.operators import tree
from leafline.sources import readers, writers
from leafline.streaming import runlog


def test_markdown_folders(spark, tmp_path):
    (tmp_path / "kb" / "sub").mkdir(parents=True)
    (tmp_path / "kb" / ".hidden").mkdir()
    (tmp_path / "kb" / "a.md").write_text("# A\né")
    (tmp_path / "kb" / "sub" / "b.md").write_text("# B")
    (tmp_path / "kb" / ".hidden" / "c.md").write_text("# C")
    (tmp_path / "kb" / "x.txt").write_text("no")
    found = {r.doc_id: r.text for r in readers.markdown(spark, str(tmp_path / "kb")).collect()}
    assert found == {"a": "# A\né", "b": "# B"}
    assert {r.rel_path for r in readers.discover(spark, str(tmp_path / "kb")).collect()} == {"a.md", "sub/b.md"}


def test_index_files_of_both_versions(spark, tmp_path):
    (tmp_path / "new.json").write_text(json.dumps({"formatVersion": 2, "nodes": [{"nodeId": "a"}]}))
    (tmp_path / "old.json").write_text(json.dumps([{"nodeId": "b"}]))
    found = {r.doc_id: (r.format_version, json.loads(r.nodes)) for r in readers.index_files(spark, str(tmp_path)).collect()}
    assert found == {"new": (2, [{"nodeId": "a"}]), "old": (1, [{"nodeId": "b"}])}


def test_query_files(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,set,pair_id,doc,node_id,question,edit_term\n1, a ,,d,n,"why, so",\n,,,,,,\n2,B,1,d,n,how,x\n')
    assert [r.id for r in readers.queries_csv(spark, str(path), ["a"]).collect()] == ["1"]
    assert readers.queries_csv(spark, str(path)).count() == 2


def test_missing_lines_are_an_empty_table(spark, tmp_path):
    assert readers.jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    (tmp_path / "some.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.jsonl(spark, str(tmp_path / "some.jsonl"), "a int").count() == 2


def test_question_sets(spark):
    text = json.dumps({"questions": [{"id": "q", "prompt": "p", "answers": [{"id": "a"}, {"id": "b"}]}]})
    assert [r.answer_id for r in readers.questions(spark, text).collect()] == ["a", "b"]
    assert readers.questions(spark, "broken").count() == 0
    assert [r.answer_id for r in readers.questions(spark, "broken", default=text).collect()] == ["a", "b"]


def test_label_pins(spark):
    text = "# A\n```pin\nid: p1\ngolden: [L1, L2]\n```\n# B\n```pin\nid: p2\n```"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    pins = readers.label_pins(docs)
    assert {(r.label, r.pin_id) for r in pins.collect()} == {("L1", "p1"), ("L2", "p1")}
    assert readers.unique_labels(pins).count() == 2
    with pytest.raises(ValueError, match="several pins: L1"):
        readers.unique_labels(pins.unionByName(pins.where("label = 'L1'").withColumn("pin_id", F.lit("p2"))))


def test_narration(spark):
    lines = spark.createDataFrame([(0, "step"), (1, "[A001] done"), (2, "more"), (3, "[A002] done"), (4, "tail")], "line_no int, line string")
    assert [r.case_id for r in readers.narration(lines).orderBy("line_no").collect()] == ["A001", "A001", "A002", "A002", None]


def test_only_given_partitions_are_overwritten(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, v int"), path, "doc_id")
    writers.write_partitions(spark.createDataFrame([("a", 3)], "doc_id string, v int"), path, "doc_id")
    assert {(r.doc_id, r.v) for r in spark.read.parquet(path).collect()} == {("a", 3), ("b", 2)}


def test_query_templates(spark, tmp_path):
    docs = spark.createDataFrame([("d", "# A\nx\n# B\ny")], "doc_id string, text string")
    writers.write_queries(tree.leaves(tree.nodes(docs)), str(tmp_path / "q"))
    rows = readers.queries_csv(spark, str(tmp_path / "q")).collect()
    assert {(r.id, r["set"], r.pair_id) for r in rows} == {("A001", "A", None), ("B001", "B", "A001"), ("A002", "A", None), ("B002", "B", "A002")}


def test_forbidden_patterns_fail(spark):
    df = spark.createDataFrame([("fine",), ("```pin",)], "text string")
    assert writers.audited(df.limit(1), "text", ["```pin"]).count() == 1
    with pytest.raises(Exception, match="forbidden"):
        writers.audited(df, "text", ["```pin"]).collect()


def test_run_log_stream(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [(1.0, "chat", "r1", "q", {"prune": 5}, "grounded", "a", "f1"), (2.0, "chat", "r1", "q", None, None, None, "f2")]
    runlog.append_log(spark.createDataFrame(rows, runlog.LOG_SCHEMA), log)
    stream = runlog.read_log(spark, log).groupBy("run_id").agg(F.count("*").alias("n"))
    assert runlog.run_available(stream, "log_counts").first().n == 2
    assert not runlog.single_fingerprint(runlog.read_log(spark, log, stream=False)).first().stable


def test_statuses_move(spark):
    marks = [("r", "n1", 1, "kept"), ("r", "n1", 2, "retrieved"), ("r", "n2", 1, "evaluating")]
    events = spark.createDataFrame(marks, "run_id string, node string, seq int, status string")
    last = runlog.last_statuses(events, ["run_id", "node"], ["seq"])
    row = runlog.progress(last).first()
    assert (row.total, row.done, row.n_retrieved, row.n_kept) == (2, 1, 1, 0)
