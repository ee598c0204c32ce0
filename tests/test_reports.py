"""Reports, selections, listings and order over whole tables, against plain loops."""

import random

from pyspark.sql import functions as F

from leafline.functions import parsing
from leafline.operators import layout, matching, prune, reports
from leafline.store import before


def test_before_sums_across_ranges(spark):
    rng = random.Random(1)
    rows = [(g, rng.random(), rng.randint(0, 9)) for g in ("a", "b", None) for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, x double, v int").repartition(5)
    got = {(r.g, r.x): r.s for r in before(df, ["g"], [F.col("x")], F.col("v"), "s").collect()}
    for g in ("a", "b", None):
        run = 0
        for _, x, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            assert got[g, x] == run
            run += v


def test_selection_keeps_failed_batches(spark):
    children = [("p", 0, "a"), ("p", 0, "b"), ("p", 1, "c"), ("p", 1, "d"), ("q", 0, "a"), ("r", 0, "x")]
    replies = [("p", 0, '["a", "c", "zzz"]'), ("p", 1, "no idea"), ("q", 0, "[]"), ("r", 0, '[{"id": "id=x", "reason": " so "}]')]
    out = prune.parse_selection(
        spark.createDataFrame(replies, "parent string, batch int, reply string"), spark.createDataFrame(children, "parent string, batch int, node_id string")
    )
    failed = "Kept after a failed selection call"
    assert sorted(map(tuple, out.collect())) == [("p", "a", "", False), ("p", "c", "", False), ("p", "d", failed, True), ("r", "x", "so", False)]


def test_contained_against_a_loop(spark):
    rng = random.Random(3)
    words = ["ab", "abc", "b", "cab", "", "a b"]
    bodies = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(60)] + [(60, None), (61, "")]
    needles = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))) for i in range(40)] + [(40, None), (41, "")]
    got = matching.contained(spark.createDataFrame(bodies, "doc_id int, body string"), spark.createDataFrame(needles, "item_id int, needle string"))
    expected = sorted((d, i) for d, b in bodies for i, n in needles if b is not None and n is not None and n in b)
    assert sorted(map(tuple, got.collect())) == expected


def test_levels_of_legacy_headings():
    plain = [None] * 9
    assert layout.plain_levels(["I. Intro", "A. Why", "B. How", "II. Method", "(1) first", "2.1 deep", "Closing"], plain[:7]) == [1, 2, 2, 1, 3, 2, 1]
    assert layout.plain_levels(["Big", "Small", "Big too", "None"], [14.0, 9.0, 14.0, None]) == [1, 2, 1, 1]
    assert layout.plain_levels(["Some", "Words"], [None, None]) == [1, 1] and layout.plain_levels([], []) == []


def test_heading_numbers():
    kinds = {
        "Section 2.1 x": ("word:section", 2), "Q3 why": ("word:q", 3), "Annex B: x": ("word:annex", 2), "A.1.2 x": ("letterdotted", 1), "(iv) x": ("paren_roman", 4),
        "b) x": ("paren_alpha", 2), "(12) x": ("paren_digit", 12), "3.2.1 x": ("dotted", 3), "IV. x": ("roman", 4), "B. x": ("alpha", 2),
    }
    assert {t: layout.marker(t)[:2] for t in kinds} == kinds
    assert layout.marker("Plain words") is None and layout.marker("") is None and layout.marker("3x") is None


def test_tables_and_sections():
    assert parsing.table_markdown("<tr><td>x</td><td rowspan='2'>y</td></tr><tr><td>z</td></tr>") == "| x | y |\n| --- | --- |\n| z |  |"
    assert parsing.answer_sections("## Short answer: yes\nmore\n**RATIONALE** why") == {"short_answer": "yes\nmore", "rationale": "why"}


def test_sentence_verdicts(spark):
    asked = [(1, "d", "costs of 12 beds", 3), (2, "d", "costs of 12 beds", 9), (3, "d", "nothing", 3), (4, "d", "beds", 3)]
    chunks = [("d", 1, [3], "There are 12 beds with costs. Other."), ("d", 2, [5], "beds")]
    out = reports.sentence_verdicts(
        spark.createDataFrame(asked, "id int, doc string, question string, page int"),
        spark.createDataFrame(chunks, "doc string, chunk_id int, pages array<int>, body string"),
    )
    got = {r.id: (r.verdict, r.chunk_id) for r in out.collect()}
    assert got == {1: ("OK", 1), 2: ("OFFPAGE", 1), 3: ("WEAK", 1), 4: ("WEAK", 1)}
