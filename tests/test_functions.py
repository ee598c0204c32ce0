import json
import math
import random
import re

from leafline.functions import parsing, text
from leafline.plans.judge import judged, lexical_judge, to_store


def column(spark, values, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in df.select("i", function("x").alias("y")).orderBy("i").collect()]


def test_tokenize_drops_stop_words_and_single_letters(spark):
    assert column(spark, ["The Cat, a x 42 of it", None, ""], text.tokenize) == [["cat", "42"], [], []]


def test_slug(spark):
    assert column(spark, ["Hello, World!", "É à", "--a--b--"], text.slug) == ["hello-world", "", "a-b"]


def test_token_estimate_matches_the_formula(spark):
    values = ["", None, "a", "abcd" * 20]
    assert column(spark, values, text.estimate_tokens) == [0 if not v else max(1, int(len(v) / 3.4) + 1) for v in values]


def test_mentions_needs_half_of_the_words(spark):
    df = spark.createDataFrame([("alpha beta gamma", "alpha delta"), ("alpha", "beta gamma"), ("x", "")], "h string, n string")
    assert [r[0] for r in df.select(text.mentions("h", "n")).collect()] == [True, False, False]


def test_titles_for_comparison(spark):
    values = ["1.2 Background", "A problem", "A Prompt", "III-B2 Details", "**Bold** – end.", "I am legend"]
    assert column(spark, values, text.normalise_title) == ["background", "a problem", "prompt", "details", "bold - end", "i am legend"]


def test_node_ids_from_echoed_lines(spark):
    values = ["- x | LEAF | t", "id=abc", "SECTION: s-1", "leaf-1", "a/b/c", "x | id=y"]
    assert column(spark, values, text.clean_node_id) == ["x", "abc", "s-1", "leaf-1", "c", "y"]


def test_answer_ids_from_echoed_lines(spark):
    known = ["q__adult", "q__child"]
    values = ["id=q__adult | Adults", "'q__child'", "see q__adult please", "nothing"]
    assert column(spark, values, lambda c: text.normalise_answer_id(c, known)) == ["q__adult", "q__child", "q__adult", None]


def test_citations_and_grounding(spark):
    values = ["[1][2]", "[2, 3]", "none", None]
    assert column(spark, values, text.cited_numbers) == [[1, 2], [2, 3], [], []]
    df = spark.createDataFrame([("[1]", 0), ("[3]", 2), ("[2]", 2)], "a string, n int")
    assert [r[0] for r in df.select(text.grounding_status("a", "n")).collect()] == ["insufficient_evidence", "partially_grounded", "grounded"]


def test_judgment_readings(spark):
    values = ["Yes.", "**No**, x", "partly", None, "nothing"]
    assert column(spark, values, text.judgment_label) == ["sufficient", "insufficient", "unparsed", "missing", "unparsed"]
    assert column(spark, values, text.judgment_ui_reading) == ["sufficient", "sufficient", "sufficient", "sufficient", "sufficient"]


def test_other_strings(spark):
    assert column(spark, ["soft­hyphen exam-\nple"], text.block_text) == ["softhyphen example"]
    assert column(spark, ["See Fig. 2 and tables 3"], text.figure_mentions) == [[("figure", 2), ("table", 3)]]


def test_sections_of_an_answer():
    found = parsing.answer_sections("**Short answer:** a\n## RATIONALE\nb\nshort-answer: c")
    assert found == {"short_answer": "c", "rationale": "b"}
    assert parsing.answer_sections(None) == {}


def test_json_of_replies():
    assert json.loads(parsing.reply_json('{"q": "the "big" one", "n": 1}')) == {"q": 'the "big" one', "n": 1}
    assert json.loads(parsing.reply_json('{"keep": ["a", "b"')) == ["a", "b"]
    assert json.loads(parsing.reply_json('```json\n{"a": {"b": 2}}\n```')) == {"a": {"b": 2}}
    assert json.loads(parsing.reply_json('words [1, 2] words')) == [1, 2]
    assert parsing.reply_json("nothing") is None
    assert json.loads(parsing.balanced('{"a": "cut')) == {"a": "cut"}


def test_balancing_keeps_valid_json():
    rng = random.Random(5)

    def value(depth):
        kind = rng.choice("snlo" if depth else "sn")
        if kind == "s":
            return "".join(rng.choice('ab \\é"') for _ in range(rng.randint(0, 6))).replace('"', "'")
        if kind == "n":
            return rng.randint(0, 99)
        return [value(depth - 1) for _ in range(2)] if kind == "l" else {str(i): value(depth - 1) for i in range(2)}

    for _ in range(300):
        v = value(3)
        assert json.loads(parsing.balanced(json.dumps(v))) == v


def test_passages_levels_tables_and_romans():
    assert parsing.reply_passages('{"passages": ["C1", {"id": "C2", "quote": "q"}]}')[1] == {"id": "C2", "quote": "q", "reason": ""}
    assert parsing.reply_passages("no") == []
    assert parsing.tiebreak_levels('x {"levels": [1, 2]} y', 2) == [1, 2]
    assert parsing.tiebreak_levels('[1, 9]', 2) is None
    html = "<table><tr><td colspan=2>a</td></tr><tr><td>b</td><td>c</td></tr></table>"
    assert parsing.table_markdown(html) == "| a |  |\n| --- | --- |\n| b | c |"
    assert [parsing.roman(x) for x in ("iv", "XII", "abc", "")] == [4, 12, None, None]


def test_only_unjudged_rows_reach_the_judge(spark):
    rows = spark.createDataFrame([("big cat", "a cat"), ("big cat", "a dog")], "query string, text string")
    calls = []

    def counted(query, body):
        calls.append(1)
        return lexical_judge(0.5)(query, body)

    first = judged(rows, counted, "leaf", "m", 1)
    store = to_store(first, "leaf", "m", 1)
    again = judged(rows.limit(1), counted, "leaf", "m", 1, store)
    plan = again._jdf.queryExecution().toString()
    assert "LeftAnti" in plan
    assert {(r.text, r.verdict.relevant) for r in first.collect()} == {("a cat", True), ("a dog", False)}


def test_cost_tiers(spark):
    from pyspark.sql import functions as F

    rates = {"short": {"input": 1, "cache_read": 0.1, "cache_write": 2, "output": 6}, "long": {"input": 2, "cache_read": 0.2, "cache_write": 4, "output": 9}}
    df = spark.createDataFrame([(1000, 100, 50, 10), (300000, 0, 0, 0)], "t long, c long, w long, o long")
    got = [r[0] for r in df.select(text.cost_usd(F.col("t"), F.col("c"), F.col("w"), F.col("o"), rates)).collect()]
    assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(got, [(850 + 10 + 100 + 60) / 1e6, 0.6]))


def test_stopwords_are_lower_case_words():
    assert len(text.STOPWORDS) == 33 and all(re.fullmatch("[a-z]+", s) for s in text.STOPWORDS)
