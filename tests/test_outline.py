"""The outline gate and trees of any depth against plain walks."""

import json
import random

from pyspark.sql import functions as F

from leafline.operators import evaluate, index, outline, tree
from leafline.plans import judge

ENTRY = "doc_id long, entry_no int, title string, level int, page int"


TITLES = [("Alpha beta", 1), ("Gamma delta", 2), ("Epsilon zeta", 3), ("Eta theta", 4)]
FLAT = [(t, 0, p) for t, p in TITLES]
#: Entries (title, level, page), the verdict, its notes and the entries (number, level) that stay.
CASES = [
    ([], "reject", ["absent"], []),
    (FLAT, "titles_only", ["flat levels"], [(0, 0), (1, 0), (2, 0), (3, 0)]),
    ([("Book", 0, 1)] + [(t, 1 + i % 2, p) for i, (t, p) in enumerate(TITLES)], "full", ["unwrapped single root"], [(1, 0), (2, 1), (3, 0), (4, 1)]),
    ([("Contents", 0, 1), ("1. Abstract", 0, 1)], "reject", ["pruned 2 service entries", "nothing after prune"], []),
    ([(f"Page {i}", 0, i) for i in range(1, 4)], "reject", ["page anchors"], []),
    ([("Alpha beta", 0, 1), ("Gamma delta", 1, 2), ("other", 0, 1)], "full", ["pruned 1 unmatched entries"], [(0, 0), (1, 1)]),
    ([("Alpha beta", 0, 9), ("Gamma delta", 0, 2), (None, 0, None)], "reject", ["pruned 2 unmatched entries", "too few entries match"], []),
    ([("Gamma delta", 0, 2), ("Alpha beta", 0, 1)], "reject", ["pages go back"], []),
    ([("Gamma delta", 0, None), ("Alpha beta", 0, -1)], "full", [], [(0, 0), (1, 0)]),  # unknown pages go nowhere
]


def test_gate_rules(spark):
    entries = [(d, i, *e) for d, case in enumerate(CASES) for i, e in enumerate(case[0])]
    titles = [(d, *t) for d in range(len(CASES)) for t in TITLES] + [(1, None, None)]
    docs = spark.createDataFrame([(d,) for d in range(len(CASES))], "doc_id long")
    verdicts, kept = outline.gate(docs, spark.createDataFrame(entries, ENTRY), spark.createDataFrame(titles, "doc_id long, title string, page int"))
    told = {r.doc_id: r for r in verdicts.collect()}
    stay = sorted((r.doc_id, r.entry_no, r.level) for r in kept.collect())
    for d, (_, verdict, notes, left) in enumerate(CASES):
        assert (told[d].verdict, told[d].notes) == (verdict, notes)
        assert [x[1:] for x in stay if x[0] == d] == left


def test_matches_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(9)] + ["x"]
    title = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 6)))
    entries = [(d, i, title(), 0, rng.choice([-1, 0, 1, 2, 3, 9])) for d in range(30) for i in range(12)]
    titles = [(d, title(), rng.choice([-1, 0, 1, 2, 3, 9])) for d in range(30) for _ in range(8)]

    def near(e, t):
        a, b = ({w for w in x.split() if len(w) > 1} for x in (e[2], t[1]))
        pages = e[4] < 0 or t[2] < 0 or abs(e[4] - t[2]) <= 1
        return pages and bool((e[2] == t[1] and e[2]) or (a and b and 10 * len(a & b) >= 7 * min(len(a), len(b))))

    expected = {(e[0], e[1]) for e in entries if any(t[0] == e[0] and near(e, t) for t in titles)}
    rows = outline.pruned(spark.createDataFrame(entries, ENTRY).where("entry_no >= 0"))
    plain = spark.createDataFrame(entries, ENTRY).withColumnRenamed("title", "norm")
    got = outline.matched(plain, spark.createDataFrame(titles, "doc_id long, title string, page int"))
    assert {tuple(r) for r in got.collect()} == expected and 20 < len(expected) < len(entries) and "norm" in rows.columns


def test_trees_of_any_depth(spark):
    rng = random.Random(9)
    entries = [(d, i, f"t{i}", rng.choice([0, 1, 2, 5, 11, 40]), 0) for d in range(12) for i in range(rng.randint(1, 25))]
    expected = set()
    for d in range(12):
        open_ = []
        for _, i, t, level, _ in [e for e in entries if e[0] == d]:
            while open_ and open_[-1][1] >= level:
                open_.pop()
            expected.add((d, i, t, level, open_[-1][0] if open_ else None, len(open_)))
            open_.append((i, level))
    got = outline.outline_tree(spark.createDataFrame(entries, ENTRY).drop("page")).collect()
    assert {tuple(r)[:6] for r in got} == expected
    parents = {(e[0], e[4]) for e in expected}
    assert all(r.is_leaf == ((r.doc_id, r.entry_no) not in parents) for r in got)


TEXT = '# A "q"\nintro\n## B\nb text\n### C\nc text\n## D\n# E\n'


def test_pruned_json_is_the_walk(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "# Only\nx"), (3, "none")], "doc_id int, text string")
    full = tree.with_ancestors(tree.nodes(docs))
    rows = {(r.doc_id, r.node_seq): r for r in full.collect()}
    keep = spark.createDataFrame([(1, 0), (1, 2), (1, 4), (1, 5), (2, 0), (1, 99)], "doc_id int, node_seq int")  # 4 lies below 3, which is gone
    kept = {tuple(r) for r in keep.collect()}

    def walk(doc, parent):
        below = [r for (d, _), r in sorted(rows.items()) if d == doc and r.parent_seq == parent]
        return [
            {"nodeId": r.node_id, "title": r.title, "headingLevel": r.heading_level, "children": walk(doc, r.node_seq)} for r in below if (doc, r.node_seq) in kept
        ]

    got = {r.doc_id: json.loads(r.tree) for r in tree.nested_json(tree.kept_within(full, keep), "depth").collect()}
    assert got == {1: walk(1, None), 2: walk(2, None)} and got[1][0]["title"] == 'A "q"'
    whole = {r.doc_id: json.loads(r.tree) for r in tree.nested_json(full.drop("ancestors", "depth", "breadcrumb")).collect()}
    kept = set(rows)
    assert whole == {1: walk(1, None), 2: walk(2, None)}


def test_section_texts(spark):
    full = tree.with_ancestors(tree.nodes(spark.createDataFrame([(1, TEXT)], "doc_id int, text string")))
    leaves = [r for r in full.orderBy("node_seq").collect() if r.is_leaf]
    for limit in (4000, 30, 12, 5):
        got = {r.node_seq: r.text for r in tree.section_texts(full, limit).collect()}
        for r in full.collect():
            below = [x for x in leaves if r.node_seq in (x.node_seq, *x.ancestors)]
            said = r.content or "\n\n".join(x.title + "\n" + (x.content or "") for x in below).strip() or "(no content)"
            assert got[r.node_seq] == said[:limit]
    asked = spark.createDataFrame([(1, "text", 1, 0), (2, "nothing", 1, 0)], "query_id int, query string, doc_id int, node_seq int")
    told = {r.query_id: (r.topic, r.addresses_query) for r in judge.explained(full, asked, judge.lexical_judge()).collect()}
    assert told == {1: ('A "q"', True), 2: ('A "q"', False)}


def test_fingerprint_by_ranges(spark):
    import hashlib

    rows = [(f"f{i}", f"{i:03}") for i in range(50)]
    files = spark.createDataFrame(rows, "name string, sha256 string")
    level = [n + s for n, s in sorted(rows)]
    while True:
        level = [hashlib.sha256("".join(level[i : i + 7]).encode()).hexdigest() for i in range(0, len(level), 7)]
        if len(level) == 1:
            break
    assert index.fingerprint(files.repartition(5), 7).first()[0] == index.fingerprint(files.coalesce(1), 7).first()[0] == level[0][:32]
    plain = hashlib.sha256("".join(n + s for n, s in sorted(rows)).encode()).hexdigest()
    assert index.fingerprint(files).first()[0] == hashlib.sha256("".join(n + s for n, s in sorted(rows)).encode()).hexdigest()[:32] == plain[:32]
    assert index.fingerprint(files.limit(0)).first()[0] == hashlib.sha256(b"").hexdigest()[:32]


def test_decoys(spark):
    pool = spark.createDataFrame([(d, f"{d}-{i}") for d in range(4) for i in range(5 if d else 30)], "doc_id long, leaf_id string")
    queries = spark.createDataFrame([(i, i % 5) for i in range(60)], "id long, doc_id long")  # document 4 has no leaves
    got = evaluate.decoys(queries, pool, 4, seed=1).collect()
    per = {}
    for r in got:
        assert r.doc_id != r.id % 5
        per.setdefault(r.id, set()).add((r.doc_id, r.leaf_id))
    assert len(per) == 60 and all(len(v) == 4 for v in per.values())
    assert sorted(map(tuple, evaluate.decoys(queries.repartition(3), pool.repartition(4), 4, seed=1).collect())) == sorted(map(tuple, got))
    assert {tuple(r) for r in evaluate.decoys(queries, pool, 4, seed=2).collect()} != {tuple(r) for r in got}
    assert evaluate.decoys(queries.where("id = 0"), pool.where("doc_id < 2"), 9, seed=1).count() == 5  # all that other documents have


def test_section_texts_end_between_leaves(spark):
    """The cut may fall on the blank line between two leaves, and white space before the text is stripped before the cut."""
    titles = ["A", " ", "B", "C"]
    for width in range(1, 14):
        contents = ["", "", "x" * width, "yy"]
        docs = [(1, 0, None, "top", 1, False, None)] + [(1, i + 1, 0, t, 2, True, c) for i, (t, c) in enumerate(zip(titles[1:], contents[1:], strict=True))]
        rows = spark.createDataFrame(docs, "doc_id int, node_seq int, parent_seq int, title string, heading_level int, is_leaf boolean, content string")
        full = tree.with_ancestors(rows.withColumn("synthetic", F.lit(False)))
        whole = "\n\n".join(f"{t}\n{c}" for t, c in zip(titles[1:], contents[1:], strict=True)).strip(" \t\n")
        got = {r.node_seq: r.text for r in tree.section_texts(full, 9).collect()}
        assert got[0] == whole[:9]


def test_hits_by_array_and_by_words(spark):
    """Documents of few titles and of many give the same hits, and few titles repeat no entry by its words and pages."""
    rng = random.Random(5)
    name = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta".split()) for _ in range(rng.randint(1, 4)))
    entries = [(d, i, name(), i % 3, rng.choice([None, -1, *range(9)])) for d in range(6) for i in range(12)]
    titles = [(d, name(), rng.choice([None, -1, *range(9)])) for d in range(5) for _ in range(3 * d)]
    rows = outline.pruned(spark.createDataFrame(entries, ENTRY))
    known = spark.createDataFrame(titles, "doc_id long, title string, page int")
    told = [{(r.doc_id, r.entry_no): r.hit for r in outline.with_hits(rows, known, few=few).collect()} for few in (0, 5, 64)]
    assert told[0] == told[1] == told[2] and len(set(told[0].values())) == 2
    plan = outline.with_hits(rows, known)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
