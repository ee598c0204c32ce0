import random

from pyspark.sql import functions as F

from leafline.operators import budget, evaluate, facets, index, layout, manifest, prune, rank, tree
from leafline.plans import retrieve

SAMPLE = """# Guideline
Root prose.

## Diagnosis
Section prose.
### Initial workup
Blood tests.
### Imaging
Scan.
## Treatment
More prose.
### First line
Drug A.
### Second line
Drug B."""


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_sample_tree(spark):
    rows = tree.nodes(docs(spark, SAMPLE)).orderBy("node_seq").collect()
    assert [r.node_id for r in rows if r.is_leaf] == [
        "guideline-overview", "diagnosis-overview", "initial-workup", "imaging", "treatment-overview", "first-line", "second-line"
    ]
    assert rows[2].node_id == "diagnosis" and rows[2].parent_seq == 0 and rows[4].parent_seq == 2
    assert rows[1].content == "Root prose." and rows[1].parent_title == "Guideline"


def test_tree_edge_cases(spark):
    rows = tree.nodes(docs(spark, "no headings", None, "# A\n### C\nx\n## A\ny\n# A", "text before\n# Z")).collect()
    by = {(r.doc_id, r.node_seq): r for r in rows}
    assert not [r for r in rows if r.doc_id < 2]
    assert [by[2, i].node_id for i in range(4)] == ["a", "c", "a-2", "a-3"]
    assert by[2, 1].parent_seq == 0 and by[2, 3].parent_seq is None and by[3, 0].content == ""


def test_trees_match_a_stack_walk(spark):
    rng = random.Random(7)
    texts = ["\n".join("#" * rng.randint(1, 5) + f" h{rng.randint(0, 3)}" for _ in range(rng.randint(0, 12))) for _ in range(40)]
    got = {(r.doc_id, r.node_seq): r for r in tree.with_ancestors(tree.nodes(docs(spark, *texts))).collect()}
    for d, t in enumerate(texts):
        stack = []
        for i, line in enumerate(t.split("\n") if t else []):
            level = len(line.split(" ")[0])
            while stack and stack[-1][0] >= level:
                stack.pop()
            assert got[d, i].parent_seq == (stack[-1][1] if stack else None)
            assert got[d, i].ancestors == [s for _, s in reversed(stack)]
            stack.append((level, i))


def test_pins_are_attached_and_stripped(spark):
    text = "# A\n```pin\npage: 3\nbbox: [1, 2]\n```\nBody\n![i](p.png)\n\n\n\nEnd"
    row = tree.nodes(docs(spark, text)).first()
    assert row.pin == {"page": "3", "bbox": "[1, 2]"} and row.content == "Body\n\nEnd"


def test_summaries(spark):
    found = tree.heuristic_summaries(tree.nodes(docs(spark, SAMPLE)))
    by = {r.node_seq: r.summary for r in found.collect()}
    assert by[0] == "Covers: Diagnosis, Treatment" and by[1] == "Root prose."


def test_bm25_against_a_loop(spark):
    import math

    texts = ["red fox jumps", "red red wine", "blue wine", "grey", ""]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    asked = spark.createDataFrame([(1, "red wine wine")], "query_id int, query string")
    got = {r.k: r for r in rank.ranked(items, asked, ["k"], "text", ["k"]).collect()}
    tokens = [t.split() for t in texts]
    mean = sum(map(len, tokens)) / len(tokens)

    def score(d):
        total = 0.0
        for q in ["red", "wine", "wine"]:
            df = sum(q in t for t in tokens)
            tf = tokens[d].count(q)
            total += math.log(1 + (len(tokens) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens[d]) / mean))
        return total

    expected = sorted(range(5), key=lambda d: (-score(d), d))
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1]["rank"])] == expected
    assert all(abs(got[d].score - score(d)) < 1e-9 for d in range(5))


def loop_scan(rows, limit, most):
    used, out, stop = 0, [], None
    for n, (cost, relevant) in enumerate(rows):
        if stop or n >= most:
            out.append(("deferred", False))
        elif relevant and used + cost > limit:
            stop = True
            out.append(("deferred", True))
        else:
            used += cost if relevant else 0
            out.append(("error" if relevant is None else "retrieved" if relevant else "rejected", False))
    return out


def test_budget_scan_against_a_loop(spark):
    rng = random.Random(3)
    cases = [[(rng.randint(1, 9), rng.choice([True, False, None])) for _ in range(rng.randint(1, 15))] for _ in range(60)]
    rows = [(c, i, *r) for c, rows in enumerate(cases) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "c int, rank int, cost int, relevant boolean")
    got = {(r.c, r["rank"]): (r.status, r.judged_relevant) for r in budget.budget_scan(df, 20, by=["c"], max_evals=10).collect()}
    for c, case in enumerate(cases):
        assert [got[c, i] for i in range(len(case))] == loop_scan(case, 20, 10)


def test_budget_fit_is_a_prefix(spark):
    df = spark.createDataFrame([(1, 4), (2, 9), (3, 1)], "i int, cost int")
    assert [r.fitted for r in budget.budget_fit(df, 8, "cost", ["i"]).orderBy("i").collect()] == [True, False, False]


def test_packed_batches(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 5, 5, 12, 1, 1, 1])], "p int, i int, cost int")
    got = [r.batch for r in budget.packed_batches(df, 3, 10, "cost", ["p"], "i").orderBy("i").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 3]


def test_facets(spark):
    leaves = spark.createDataFrame([(h,) for h in "abcd"], "leaf_hash string")
    given = [("a", "q1", ["x"]), ("a", "q2", ["u"]), ("b", "q1", ["y"]), ("c", "q1", [])]
    stored = spark.createDataFrame(given, "leaf_hash string, question_id string, answer_ids array<string>")
    questions = {"q1": ["x", "y"], "q2": ["u", "v"]}

    def kept(selected, mode):
        out = facets.select_leaves(leaves, stored, selected, questions, mode)
        return {r.leaf_hash for r in out.where("kept").collect()}

    assert kept(["x"], "any") == {"a", "d"}
    assert kept(["x", "y", "u"], "all") == {"a", "b", "d"}
    assert kept(["gone"], "all") == {"d"}
    assert kept([], "any") == set("abcd")
    assert kept(["x", "u"], "all") <= kept(["x", "u"], "any")


def test_prune_against_a_walk(spark):
    full = tree.with_ancestors(tree.nodes(docs(spark, SAMPLE)))
    picked = full.where("node_id IN ('diagnosis', 'imaging', 'first-line')").withColumn("reason", F.lit("r"))
    got = {r.node_id: (r.status, r.reason, r.judged) for r in prune.survivors(full, picked).collect()}
    assert got["guideline"][0] == "kept" and got["diagnosis"][0] == "kept" and got["imaging"][0] is None
    assert got["treatment"] == ("pruned", None, True)
    assert got["first-line"] == ("pruned", "Pruned because ancestor section 'Treatment' was pruned.", False)


def test_every_leaf_has_one_verdict(spark):
    full = tree.with_ancestors(tree.nodes(docs(spark, SAMPLE))).withColumn("summary", F.lit(""))
    asked = spark.createDataFrame([(1, "drug scan")], "query_id int, query string")
    picked = full.where("node_id = 'diagnosis' OR node_id = 'imaging'").withColumn("reason", F.lit("r"))
    rows = retrieve.retrieve(full, asked, 1000, selected=picked).collect()
    assert len(rows) == 7 == len({r.node_seq for r in rows})
    assert {r.node_id for r in rows if r.rehydrated} == {"first-line", "second-line"}
    assert [r.source_no for r in sorted(rows, key=lambda r: r.node_seq) if r.status == "retrieved"] == [1, 2, 3]


def test_manifest(spark):
    files = spark.createDataFrame([("a b/x.md",), ("a_b/x.md",), ("y.z.md",)], "rel_path string")
    ids = {r.rel_path: r.doc_id for r in manifest.doc_ids(files).collect()}
    assert ids == {"a b/x.md": "a_b__x", "a_b/x.md": "a_b__x-2", "y.z.md": "y.z"}
    old = spark.createDataFrame([("s", "id1", ["m"]), ("t", "id2", ["n"])], "source_path string, doc_id string, manual_tags array<string>")
    new = spark.createDataFrame([("s", "other", [])], "source_path string, doc_id string, manual_tags array<string>")
    assert {(r.doc_id, *r.manual_tags) for r in manifest.upsert(old, new).collect()} == {("id1", "m"), ("id2", "n")}


def test_summaries_are_reused(spark):
    full = tree.with_ancestors(tree.nodes(docs(spark, SAMPLE)))
    none = spark.createDataFrame(
        [], "doc_id int, node_id string, content_hash string, summary string, summary_model string, summary_prompt_version int, summary_source string"
    )
    first = index.summarise(full, none, lambda c: F.substr(c, F.lit(1), F.lit(12)), "m")
    rows = [tuple(r) for r in first.select("doc_id", "node_id", "content_hash", "summary", "summary_model", "summary_prompt_version", "summary_source").collect()]
    before = spark.createDataFrame(rows, none.schema)
    same = index.summarise(full, before, lambda c: F.upper(c), "m")
    assert same.where("NOT reused").count() == 0
    changed = tree.with_ancestors(tree.nodes(docs(spark, SAMPLE.replace("Drug A.", "Drug AA."))))
    fresh = {r.node_id for r in index.summarise(changed, before, lambda c: F.substr(c, F.lit(1), F.lit(12)), "m").where("NOT reused").collect()}
    assert fresh == {"first-line"}  # its summary came out the same, so the sections above keep theirs


def test_evaluation_helpers(spark):
    rows = [("1", 1, "a", ["a"]), ("2", 2, "b", ["a"]), ("3", 3, "a", ["b"])]
    df = spark.createDataFrame(rows, "id string, pos int, gold string, retrieved array<string>")
    assert {r.id: r.donor for r in evaluate.derange(df).collect()} == {"1": "3", "2": "1", "3": "1"}
    ranks = spark.createDataFrame([("A", 1), ("A", None), ("B", 4)], "set string, rank int")
    by = {r["set"]: r for r in evaluate.rank_summary(ranks).collect()}
    assert by["all"].mrr == round((1 + 0.25) / 3, 4) and by["A"].missing == 1 and by["A"].recall_at_1 == 0.5


def test_layout(spark):
    rows = [(1, 0, 0, 10.0, 1.0), (1, 0, 1, 20.0, None), (1, 0, 2, 5.0, None)]
    df = spark.createDataFrame(rows, "doc_id int, page int, n int, y0 double, order double")
    assert {r.n: r.order for r in layout.infer_order(df).collect()} == {0: 1.0, 1: 1.5, 2: 0.5}
    boxes = [
        (1, 0, 0, "caption", 0.0, 50.0, 10.0, 60.0, 100.0), (1, 0, 1, "content", 0.0, 10.0, 10.0, 45.0, 100.0),
        (1, 0, 2, "content", 20.0, 10.0, 30.0, 45.0, 100.0), (1, 0, 3, "caption", 0.0, 95.0, 10.0, 99.0, 100.0),
    ]
    made = spark.createDataFrame(boxes, "doc_id int, page int, n int, kind string, x0 double, y0 double, x1 double, y1 double, page_height double")
    assert {r.caption_no: r.content_no for r in layout.pair_captions(made).collect()} == {0: 1, 3: None}
    cells = [(1, "a", 10.0, 10.0, 10.0), (1, "b", 100.0, 12.0, 10.0), (1, "c", 12.0, 40.0, 10.0)]
    grid = layout.table_grid(spark.createDataFrame(cells, "table_id int, text string, x double, y double, h double")).first()
    assert grid.markdown == "| a | b |\n| --- | --- |\n| c |  |"


LEVELS = [
    (["1 Intro", "1.1 Why", "1.2 How", "2 Next", "Free"], [1, 2, 2, 1, None], "high high high high none"),
    (["I. One", "A. x", "B. y", "II. Two", "A. z"], [1, 2, 2, 1, 2], "med med med med med"),  # letters begin again below the second section
    (["A. a", "B. b", "C. c", "I. i", "J. j"], [1, 1, 1, 2, 1], None),  # I follows nothing here: a roman one, in its own series
    (["H. h", "I. i", "J. j"], [1, 1, 1], "low low low"),  # but after H it is the next letter
    (["I. i", "A. a", "II. ii", "B. b"], [1, 2, 1, 2], "low low low low"),  # no restart: kinds rank by their first member
    (["A. a", "A.1 b", "A.2 c", "Section 1 d"], [1, 2, 2, 1], None),
    (["2.1 a", "1) b", "2) c", "(a) d", "(b) e"], [2, 3, 3, 4, 4], "high low low low low"),
    (["Plain", "", "other"], [None, None, None], "none none none"),
]


def test_levels(spark):
    rows = [(d, i, t) for d, (titles, _, _) in enumerate(LEVELS) for i, t in enumerate(titles)] + [(99, 0, None)]
    found = layout.heading_levels(spark.createDataFrame(rows, "doc_id int, n int, title string")).collect()
    by = {(r.doc_id, r.n): (r.level, r.confidence) for r in found}
    assert by.pop((99, 0)) == (None, "none") and len(by) == len(rows) - 1
    for d, (titles, levels, sure) in enumerate(LEVELS):
        assert [by[d, i][0] for i in range(len(titles))] == levels, titles
        assert sure is None or [by[d, i][1] for i in range(len(titles))] == sure.split()


def test_titles_are_consumed_in_order(spark):
    heads = spark.createDataFrame([(1, 0, "A"), (1, 5, "B"), (1, 9, "A")], "doc_id int, line_idx int, title string")
    given = spark.createDataFrame([(1, 0, "a"), (1, 1, "x"), (1, 2, "a")], "doc_id int, entry_no int, title string")
    assert {r.line_idx: r.entry_no for r in layout.consume_titles(heads, given).collect()} == {0: 0, 5: None, 9: 2}


def test_heading_levels_read_titles_once(spark):
    """What follows the reading of titles reads its stored result, in each of its branches."""
    rows = spark.createDataFrame([(1, 0, "1. One"), (1, 1, "A. Part"), (1, 2, "About")], "doc_id int, n int, title string")
    plan = layout.heading_levels(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "LocalRelation" not in plan and "LogicalRDD" not in plan
