"""Stages of heading levels, text under headings, markdown of trees, groups of assets, sinks that refuse."""

import json

import pytest

from leafline.operators import ingest, layout, reports, tree
from leafline.sources import readers, writers

HEADS = "doc_id string, n int, title string, size double, weight int"


def test_fonts_take_known_levels_or_lie_below(spark):
    rows = [("a", 0, 20.0, 7, 1), ("a", 1, 14.0, 4, 2), ("a", 2, 14.0, 4, None), ("a", 3, 10.0, 4, None), ("a", 4, 30.0, 4, None), ("a", 5, None, None, None)]
    rows += [("b", 0, 12.0, 4, None), ("b", 1, 16.0, 4, None), ("b", 2, 16.0, 7, None), ("c", 0, None, None, 3)]
    df = spark.createDataFrame(rows, "doc_id string, n int, size double, weight int, level int")
    got = {(r.doc_id, r.n): (r.level, r.signal) for r in layout.typography_levels(df).collect()}
    t = "typography"
    assert [got["a", n] for n in range(6)] == [(1, "marker"), (2, "marker"), (2, t), (3, t), (3, t), (1, "flat")]
    assert [got["b", n] for n in range(3)] == [(3, t), (2, t), (1, t)] and got["c", 0] == (3, "marker")


def test_rungs(spark):
    rows = [("none", 0, "1.1 a", None, None), ("full", 0, "x", None, None), ("flat", 0, "x", None, None), ("flat", 1, "y", None, None)]
    rows += [("bad", 0, "x", None, None), ("silent", 0, "x", 9.0, 4), ("font", 0, "1.1 a", 9.0, 4), ("font", 1, "b", 9.0, 4)]
    heads = spark.createDataFrame(rows, HEADS)
    docs = spark.createDataFrame([(d,) for d in ("empty", "none", "full", "flat", "bad", "silent", "font")], "doc_id string")
    outlines = spark.createDataFrame(
        [("full", "full", [("Z", 0)]), ("flat", "titles_only", [("Z", 0)])], "doc_id string, verdict string, entries array<struct<title:string,level:int>>"
    )
    replies = spark.createDataFrame([("flat", "so: [1, 2]"), ("bad", "[9]"), ("none", "[6]")], "doc_id string, reply string")
    got = {r.doc_id: r for r in ingest.ladder(docs, heads, outlines, replies).collect()}
    assert {d: r.rung for d, r in got.items()} == {"empty": -1, "none": 1, "full": 0, "flat": 4, "bad": 5, "silent": 5, "font": 2}
    assert got["empty"].headings is None and [tuple(h) for h in got["full"].headings] == [(0, "Z", 1, "high", "outline")]
    assert [tuple(h) for h in got["flat"].headings] == [(0, "x", 1, "med", "reply"), (1, "y", 2, "med", "reply")]
    assert [h.signal for h in got["font"].headings] == ["marker", "typography"]
    assert {r.doc_id: r.rung for r in ingest.ladder(docs, heads).collect()} == {"empty": -1, "none": 1, "full": 1, "flat": 1, "bad": 1, "silent": 2, "font": 2}


def _tree(spark, rows):
    return ingest.content_tree(spark.createDataFrame(rows, "doc_id string, n int, page int, y0 double, is_title boolean, level int, text string"))


def test_text_goes_under_the_title_before(spark):
    rows = [
        ("d", 0, 0, 1.0, False, None, "author"), ("d", 1, 0, 9.0, True, 1, "One"), ("d", 2, 0, 2.0, False, None, "band"),
        ("d", 3, 0, 10.0, False, None, " a "), ("d", 4, 1, 0.0, True, None, "Demoted"), ("d", 5, 1, 1.0, True, 2, "Sub"),
        ("d", 6, 1, 2.0, False, None, "b"), ("d", 7, 1, 3.0, True, 2, "Empty"), ("d", 8, 1, 4.0, True, 1, "Gone"), ("d", 9, 1, 5.0, True, 2, "Gone too"),
        ("d", 10, 2, 5.0, True, 1, "Three"), ("d", 11, 2, 5.0, True, 2, "Three"), ("d", 12, 2, 6.0, False, None, "c"),
        ("p", 0, 0, 0.0, False, None, "memo"), ("p", 1, 0, 1.0, False, None, "end"), ("p", 2, 0, 1.0, False, None, None), ("e", 0, 0, 0.0, True, 1, "Only"),
    ]
    tree = _tree(spark, rows)
    got = [tuple(r) for r in tree.orderBy("doc_id", "node_seq").select("doc_id", "title", "depth", "is_leaf", "content").collect()]
    assert got == [
        ("d", "One", 0, False, None), ("d", "One", 1, True, "a Demoted"), ("d", "Sub", 1, True, "b"),
        ("d", "Three", 0, False, None), ("d", "Three", 1, True, "c"), ("p", None, 0, True, "memo end"),
    ]
    titles = spark.createDataFrame([("d", "Doc"), ("p", ""), ("x", "No tree")], "doc_id string, doc_title string")
    assets = spark.createDataFrame(
        [("d", 0, "sub", "![1]"), ("d", 1, "Nowhere", "![2]"), ("d", 2, "Three", "![1]")], "doc_id string, n int, title string, link string"
    )
    got = {r.doc_id: r.markdown for r in ingest.tree_markdown(tree, titles, assets).collect()}
    parts = ["# Doc\n", "## One\n", "a Demoted\n", "### Sub\n", "b\n", "![1]\n", "## Three\n", "c\n", "## Figures and Tables\n", "![2]\n"]
    assert got == {"d": "\n".join(parts), "p": "memo end\n"}
    assert {r.doc_id for r in ingest.tree_markdown(tree).collect()} == {"d", "p"}
    assert _tree(spark, []).count() == 0


def test_assets_are_grouped(spark):
    rows = [("d", 1, 2, 0, "figure", False), ("d", 2, 2, 1, "table", False), ("d", 2, 2, 2, "figure", False), ("d", 2, 2, 3, "figure", True)]
    rows += [("d", 3, 6, n, "table", False) for n in (4, 5)]
    df = spark.createDataFrame(rows, "doc_id string, section int, level int, n int, type string, is_icon boolean")
    got = [(r.group, r.heading_level) for r in ingest.asset_groups(df).orderBy("n").collect()]
    both = "Figures and tables"
    assert got == [(None, 3), (both, 4), (both, 4), (ingest.ICONS, 3), ("Tables", 6), ("Tables", 6)]


def test_sessions_and_recognised_files(spark, tmp_path):
    state = {"document": {"pages": []}, "regions": [{"type": "text", "text": "t", "page": 0}]}
    for folder in ("a/s1", "a/.cache/s2", "b"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "final_state.json").write_text(json.dumps(state))
    assert {r.doc_id: r.regions[0].text for r in readers.sessions(spark, str(tmp_path)).collect()} == {"a/s1": "t", "b": "t"}
    assert [r.doc_id for r in readers.sessions(spark, str(tmp_path / "b")).collect()] == [""]
    files = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, sha256 string")
    cache = spark.createDataFrame([("1", "new", "B"), ("2", "old", "C")], "sha256 string, config string, blocks string")
    hit, miss = readers.recognised(files, cache, "new")
    assert [(r.path, r.blocks) for r in hit.collect()] == [("x", "B")] and [r.path for r in miss.collect()] == ["y"]


def test_sinks(spark, tmp_path):
    entries = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    writers.put_cache(entries, f"{tmp_path}/cache")
    writers.clear_cache(spark, f"{tmp_path}/cache", ["a", "zz"])
    assert [r.key for r in spark.read.parquet(f"{tmp_path}/cache").collect()] == ["b"]
    writers.write_markdown(spark.createDataFrame([("d1", "# x"), ("d2", "# y")], "doc_id string, text string"), f"{tmp_path}/kb")
    writers.write_markdown(spark.createDataFrame([("d2", "# z")], "doc_id string, text string"), f"{tmp_path}/kb")
    assert {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/kb").collect()} == {"d1": "# x", "d2": "# z"}
    found = "query_id string, target_leaf string, problem string"
    writers.write_gold_map(spark.createDataFrame([("q", "x", None)], found), f"{tmp_path}/gold")
    assert spark.read.parquet(f"{tmp_path}/gold").count() == 1
    for rows in ([("q", "x", None), ("q", "y", None)], [("q", "x", "label has no pin")]):
        with pytest.raises(ValueError, match="gold map not written: q"):
            writers.write_gold_map(spark.createDataFrame(rows, found), f"{tmp_path}/no")
    results = spark.createDataFrame([("q", 1, "old"), ("q", 2, "new"), ("r", 1, "only")], "query_id string, n int, answer string")
    other = spark.createDataFrame([("q", "p")], "query_id string, prompt string")
    writers.write_archive(results, other, other.withColumnRenamed("prompt", "gold"), f"{tmp_path}/archive")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/archive").collect())) == [("q", 2, "new", "p", "p"), ("r", 1, "only", None, None)]
    with pytest.raises(Exception, match="forbidden"):
        writers.write_corpus(spark.createDataFrame([("secret",)], "text string"), f"{tmp_path}/c", ["secret"])


def test_listings(spark):
    cases = spark.createDataFrame([("A1", 1, "How so", "x"), ("A2", 0, "why", "y"), ("how", 2, "no", "x")], "id string, pos int, question string, category string")
    assert [r.id for r in reports.suggestions(cases, " HOW ").collect()] == ["A1", "how"]
    assert [r.id for r in reports.suggestions(cases, "", "x", 1).collect()] == ["A1"] and reports.suggestions(cases).count() == 3
    rows = [("c", 0, None, "user", "q", None, None), ("c", 1, "m1", "assistant", "q", None, None), ("c", 2, None, "assistant", "q", None, None)]
    rows += [("c", 3, "m3", "assistant", "r", "grounded", ["s", "t"])]
    chat = spark.createDataFrame(rows, "chat_id string, pos int, id string, role string, query string, status string, sources array<string>")
    got = sorted(map(tuple, reports.evidence_groups(chat).collect()))
    assert got == [("c", "m1", "Answer 1", "q", "not_connected", 0), ("c", "m3", "Answer 2", "r", "grounded", 2)]
    assert reports.preflight({"fingerprint": "f"}) == [] and len(reports.preflight({"stale_docs": ["d"], "completeness_check": False, "busy": True})) == 4
    assert reports.preflight({"fingerprint": "f", "busy": True}, True) == []


def test_index_files_become_nodes(spark):
    leaf = {"nodeId": "b", "title": "B", "headingLevel": 2, "lineIdx": 3, "content": "t", "synthetic": True, "parentTitle": "A"}
    nested = [{"nodeId": "a", "title": "A", "headingLevel": 1, "lineIdx": 0, "summary": "s", "children": [leaf, {"nodeId": "c"}]}, {"nodeId": "d"}]
    files = [("x", json.dumps(nested)), ("y", None), ("z", "[{"), ("e", "[]"), ("o", "{}")]
    got = [tuple(r) for r in tree.from_json(spark.createDataFrame(files, "doc_id string, nodes string")).collect()]
    assert got == [
        ("x", 0, None, "a", "A", 1, 0, False, False, None, None, "s"), ("x", 1, 0, "b", "B", 2, 3, True, True, "A", "t", ""),
        ("x", 2, 0, "c", None, None, None, True, False, None, None, ""), ("x", 3, None, "d", None, None, None, True, False, None, None, ""),
    ]
