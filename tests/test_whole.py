"""Queries over all rows and whole texts, against brute force."""

import math
import random
import re

from leafline import report_queries  # noqa: F401  they register their queries
from leafline.functions.text import STOPWORDS
from leafline.queries import QUERIES

ANSWERS = [
    (1, "The ward had 12 beds and 3.5 nurses"), (7, "cleaning of the rooms"), (9, "12 rooms were closed"), (12, "nothing alike"), (40, "beds; nurses")
]
CHUNKS = [
    (1, "There were 12 beds. Rooms of 3.5 metres; closed rooms: none. The nurses left in 1999. Beds and nurses."),
    (2, "Nurses only. No match here. Cleaning rooms takes time."),
    (3, "Nil."),
]


def test_best_sentence(spark, tmp_path):
    spark.createDataFrame(ANSWERS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(CHUNKS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    nums = lambda t: set(re.findall(r"[0-9]+(?:[.][0-9]+)?", t))
    words = lambda t: set(re.findall("[a-z]{3,}", t.lower())) - set(STOPWORDS)
    expected = []
    for i, answer in ANSWERS:
        for d, text in CHUNKS:
            found = []
            for n, x in enumerate(re.split(r"(?<=[.;:])\s+", text)):
                score = 4 * len(nums(x) & nums(answer)) + len(words(x) & words(answer)) + 2 * bool(re.search("[0-9]", x))
                found += [(-score, n)] if score else []
            expected += [(i, d, n, -score) for score, n in sorted(found)[:3]]
    got = [(r.answer_id, r.doc_id, r.sentence_no, r.score) for r in QUERIES["best_sentence"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(expected)


def test_retrieve_gives_every_document_a_verdict(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["thing", "onth", "ered", "ering", *[f"w{i}" for i in range(30)]]
    docs = [(d, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 120)))) for d in range(600)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = "thing onth ered the ering".replace("the ", "").split()
    terms = {d: (t + "\n\n" + t).split() for d, t in docs}  # title, no summary, content
    mean = sum(map(len, terms.values())) / len(terms)
    df = {q: sum(q in x for x in terms.values()) for q in asked}

    def score(x):
        tf = {q: x.count(q) for q in asked}
        return sum(math.log1p((600 - df[q] + 0.5) / (df[q] + 0.5)) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(x) / mean)) for q, n in tf.items() if n)

    order = sorted(docs, key=lambda r: (-round(score(terms[r[0]]), 9), r[0]))
    expected, used, over = {}, 0, False
    for rank, (d, t) in enumerate(order):
        cost = int(len(t + "\n" + t) / 3.4) + 1 + 16
        fits = len(set(asked) & set(terms[d])) >= 2
        over = over or rank >= 400 or (fits and used + cost > 6000)
        used += cost if fits and not over else 0
        expected[d] = (rank, "deferred" if over else "retrieved" if fits else "rejected", round(score(terms[d]), 4))
    got = {r.doc_id: (r.rank, r.status, r.score) for r in QUERIES["retrieve"](spark, str(tmp_path)).collect()}
    assert got.keys() == expected.keys()
    assert all(got[d][:2] == e[:2] and abs(got[d][2] - e[2]) < 2e-4 for d, e in expected.items())


def test_mentions_reads_whole_needles(spark, tmp_path):
    first = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"  # over 60 characters
    rest = "one two three four five six seven eight nine ten eleven twelve thirteen"
    needles = [(1, f"{first} {rest}"), (2, "alpha beta"), (3, "a of"), (4, None)]
    docs = [(1, rest), (2, first), (3, "alpha"), (4, None), (5, f"{rest} alpha")]
    spark.createDataFrame(needles, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = lambda t: {w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) > 2}
    expected = {}
    for i, n in needles:
        k = sum(2 * len(words(n) & words(h)) >= len(words(n)) > 0 for _, h in docs)
        expected |= {i: k} if k else {}
    assert {r.item_id: r.n_docs for r in QUERIES["mentions"](spark, str(tmp_path)).collect()} == expected


def test_pair_drift_pairs_all_turns(spark, tmp_path):
    rng = random.Random(4)
    letters = ["".join(rng.choice("abc") for _ in range(3)) for _ in range(20)]
    turns = [(c, t, "r", " ".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))) for c in (1, 2, 31) for t in range(7)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    words = {(c, t): set(x.split()) for c, t, _, x in turns}
    expected = {}
    for c, t in words:
        if t % 2 == 0 and (c, t + 1) in words:
            a, b = words[c, t], words[c, t + 1]
            expected[f"{c}-{t}"] = (a == b, round(len(a & b) / len(a | b), 6) if a | b else 1.0, len(a - b))
    got = {r.pair_id: (r.same_set, r.jaccard, r.n_only_a) for r in QUERIES["pair_drift"](spark, str(tmp_path)).collect()}
    assert got == expected


TURNS = [(4, 0, "as in [7] and [8,\n9]"), (5, 0, None), (6, 0, "plain [3]"), (7, 0, ""), (8, 1, "[0]"), (9, 1, "[2"), (9, 2, "x")]


def test_cited_numbers_reads_the_turns(spark, tmp_path):
    """Numbers come from the texts themselves, in every form of brackets."""
    spark.createDataFrame(TURNS, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.cited for r in QUERIES["cited_numbers"](spark, str(tmp_path)).collect()}
    assert got == {(4, 0): [7, 8, 9, 1, 2, 4], (5, 0): [9], (6, 0): [3, 1, 12, 3], (7, 0): [], (8, 1): [0, 2, 12, 3], (9, 1): [], (9, 2): [11]}


def test_grounding_tells_three_statuses(spark, tmp_path):
    spark.createDataFrame(TURNS, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.status for r in QUERIES["grounding"](spark, str(tmp_path)).collect()}
    none, some, full = "insufficient_evidence", "partially_grounded", "grounded"
    assert got == {(4, 0): full, (5, 0): none, (6, 0): full, (7, 0): some, (8, 1): full, (9, 1): none, (9, 2): some}


def test_best_sentences_sum_pairs_once(spark):
    from leafline.operators.evaluate import best_sentences

    chunks, answers = spark.createDataFrame(CHUNKS, "doc_id long, text string"), spark.createDataFrame(ANSWERS, "answer_id long, answer string")
    plan = best_sentences(chunks, answers)._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"Aggregate \[answer_id#\d+L, doc_id", plan)) == 1
