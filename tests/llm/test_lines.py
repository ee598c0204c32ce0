"""Line deduplication against all pairs of lines."""

import random
import re

from leafline.llm import lines
from tests.llm.test_llm_operators import groups


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    """(doc_id, line_no) cut by the groups of all pairs with word similarity 0.8 or more, and how many such pairs of unequal lines."""
    found = []
    for doc, text in rows:
        for no, line in enumerate(text.split("\n")):
            w = [x for x in re.split(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", line.lower()) if x]
            if len(w) >= lines.MIN_WORDS:
                found.append((doc, no, w))
    near = lambda a, b: 5 * distance(a, b) <= max(len(a), len(b))
    links = [(i, j) for i in range(len(found)) for j in range(i) if near(found[i][2], found[j][2])]
    n = len({tuple(sorted((tuple(found[i][2]), tuple(found[j][2])))) for i, j in links if found[i][2] != found[j][2]})
    return {found[i][:2] for i, g in enumerate(groups(len(found), links)) if g != i}, n


def edited(rng, line, words, share):
    w = list(line)
    for _ in range(int(len(w) * share)):
        at = rng.randrange(len(w))
        rng.choice([lambda: w.__setitem__(at, rng.choice(words)), lambda: w.insert(at, rng.choice(words)), lambda: w.pop(at)])()
    return w


def made(rng, families, size, most=40):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(120)]
    out = []
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.randint(5, most))]
        out += [" ".join(edited(rng, base, words, rng.choice([0, 0.1, 0.2, 0.3]))) for _ in range(size)]
    rng.shuffle(out)
    return [(d, "\n".join(out[3 * d : 3 * d + 3])) for d in range(len(out) // 3)]


def test_all_similar_pairs_are_found(spark):
    rows = made(random.Random(5), 30, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected, n = brute(rows)
    assert n > 50
    cut = {r.doc_id: r for r in lines.dedup_lines(docs, lines.similar_lines).collect()}
    assert {(r.doc_id, r.line_no) for r in lines.similar_lines(docs).collect()} == expected
    for d, text in rows:
        assert cut[d].text == "\n".join(x for i, x in enumerate(text.split("\n")) if (d, i) not in expected)


def test_the_query_compares_all_pairs(spark, tmp_path):
    from leafline.llm.queries import QUERIES

    rows = made(random.Random(6), 20, 6)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected, _ = brute(rows)
    got = {r.doc_id: r.n_removed for r in QUERIES["op9_fuzzy_lines"](spark, str(tmp_path)).collect()}
    assert got == {d: sum(k[0] == d for k in expected) for d, _ in rows}


def test_crowds_lose_no_pairs(spark):
    rows = made(random.Random(7), 3, 70, 15)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected, _ = brute(rows)
    for crowd in (2, 10, 1000):
        assert {(r.doc_id, r.line_no) for r in lines.similar_lines(docs, crowd).collect()} == expected


def test_long_lines_are_found(spark):
    rng = random.Random(8)
    rows = made(rng, 12, 5, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected, n = brute(rows)
    got = {(r.doc_id, r.line_no) for r in lines.similar_lines(docs).collect()}
    assert got <= expected and len(got) >= 0.9 * len(expected) and n > 10


def test_repeated_rows_and_null_ids(spark):
    line = " ".join("".join(chr(97 + int(x)) for x in str(i)) for i in range(1000, 1100))
    docs = spark.createDataFrame([(None, line)] * 900 + [(None, line + " more")], "doc_id long, text string").repartition(3)
    out = lines.dedup_lines(docs).collect()
    assert len(out) == 901 and len({r.text for r in out if r.n_removed == 0}) == 1
    assert sum(r.n_removed for r in out) in (1, 900)


def test_columns_and_odd_texts(spark):
    line = "five words are in this"
    rows = [(1, f"{line}\n{line}!", 7, "a"), (2, None, 8, "b"), (3, "", 9, "c"), (4, f"short\n{line.upper()}", 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, __cut string")
    out = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert [out[i].text for i in (1, 2, 3, 4)] == [line, None, "", "short"]
    assert [(out[i].n_lines, out[i].n_removed) for i in (1, 2, 3, 4)] == [(2, 1), (0, 0), (1, 0), (2, 1)]
    assert [out[i].asDict()["__cut"] for i in (1, 2, 3, 4)] == ["a", "b", "c", None]


def test_lines_that_share_only_late_couples_are_found(spark):
    """Edits that spoil each of a long line's first eight couples still leave the pair similar."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    for n in (50, 80):
        base = [word(4) for _ in range(n)]
        for at in range(2, n, 5):
            base[at] = word(12)  # long words come first in the order of couples
        other = [word(12) if len(w) == 12 else w for w in base]
        rows = [(0, " ".join(base)), (1, " ".join(other))]
        expected, pairs = brute(rows)
        assert pairs == 1 and expected == {(1, 0)}
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert {(r.doc_id, r.line_no) for r in lines.similar_lines(docs).collect()} == expected


def test_long_lines_lose_no_pairs(spark):
    rows = made(random.Random(8), 12, 5, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.line_no) for r in lines.similar_lines(docs).collect()} == brute(rows)[0]


def test_lines_of_one_node_share_no_codes_and_shuffles_go(spark):
    rows = [(d, "seven plain words make this whole line\nSeven plain, words make this whole line!") for d in range(3)]
    places = lines.marked_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert places.count() == 6 and lines.shared_codes(places).count() == 0
    more = places.unionByName(lines.marked_lines(spark.createDataFrame([(9, "seven plain words make this whole lines")], "doc_id long, text string")))
    assert {r.k for r in lines.shared_codes(more).collect()} == {7}
    before = spark.conf.get(lines.CLEANUP)
    with lines._tidy(spark):
        assert spark.conf.get(lines.CLEANUP) == "true"
    assert spark.conf.get(lines.CLEANUP) == before


def test_strings_tell_words_apart_by_40_bits(spark):
    docs = spark.createDataFrame([(1, "some words here\nsome other words")] * 2, "doc_id long, text string")
    at = docs.distinct().selectExpr("explode(array(0, 1)) AS no", "doc_id", "xxhash64(text) AS text_key")
    own = lines.line_strings(at.selectExpr("CAST(no AS LONG) AS node", "struct(doc_id, text_key, no AS line_no) AS place"), docs).collect()
    rows = {r.node: r for r in own}
    assert len(own) == 2 and all(len(r.x) == len(r.y) == r.n == 3 for r in own)
    for v in ("x", "y"):
        assert rows[0][v][0] == rows[1][v][0] and rows[0][v][1] == rows[1][v][2] and len(set(rows[0][v] + rows[1][v])) == 4


def test_codes_are_met_in_turns_and_no_group_is_lost(spark):
    rows = made(random.Random(12), 12, 8, 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    places = lines.marked_lines(docs).cache()
    met = lambda *turn: {(r.code, r.node) for r in lines.shared_codes(places, *turn).collect()}
    parts = [met(turn, 3) for turn in range(3)]
    assert all(parts) and sum(map(len, parts)) == len(set().union(*parts)) and set().union(*parts) == met()
    roots = [{tuple(r) for r in lines.components(lines.similar_links(places, docs, crowd, turns)).collect()} for crowd, turns in ((64, 1), (64, 3), (4, 2))]
    assert roots[0] and roots[0] == roots[1] == roots[2]


def test_only_pairs_still_apart_are_compared_after_the_first(spark, monkeypatch):
    """Of a family of 20 lines that are all similar, at most 20 of the 190 pairs are compared."""
    base = "some words of a family that stay in each of these lines".split()
    rows = [(d, " ".join([*base, "".join(chr(97 + int(x)) for x in str(100 + d))])) for d in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, plain = [], lines.similar

    def counted(pairs, own):
        seen.append(pairs.count())
        return plain(pairs, own)

    monkeypatch.setattr(lines, "similar", counted)
    assert lines.similar_lines(docs).count() == 19 and 0 < sum(seen) <= 20


def test_codes_go_when_they_have_met_and_many_pairs_are_compared_in_turns(spark, monkeypatch):
    rows = made(random.Random(13), 6, 6, 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone, calls, plain, remove = [], [], lines._similar, lines.remove_path
    monkeypatch.setattr(lines, "PAIRS_AT_ONCE", 5)
    monkeypatch.setattr(lines, "_similar", lambda pairs, own: calls.append(1) or plain(pairs, own))
    monkeypatch.setattr(lines, "remove_path", lambda spark, path: gone.append(path) or remove(spark, path))
    assert {(r.doc_id, r.line_no) for r in lines.similar_lines(docs).collect()} == brute(rows)[0]
    assert len(gone) == 1 and len(calls) >= lines.TURNS


def test_rounds_that_would_take_in_little_are_left_out(spark, monkeypatch):
    """Lines are read for the first pairs and once more for all others; whichever rounds are held, the groups are those of all pairs."""
    rows = made(random.Random(7), 3, 40, 15)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected, read, plain = brute(rows)[0], [], lines._read
    monkeypatch.setattr(lines, "_read", lambda *a: read.append(1) or plain(*a))
    cut = lambda: {(r.doc_id, r.line_no) for r in lines.similar_lines(docs, 4).collect()}
    assert cut() == expected and len(read) == 2
    monkeypatch.setattr(lines, "MET_AT_ONCE", -1, raising=False)
    assert cut() == expected


def test_when_all_pairs_are_met_at_once():
    class Pairs:
        def __init__(self, n):
            self.n = n

        def count(self):
            return self.n

    rows = 10
    few, many = lambda: Pairs(lines.NEAR_AT_ONCE * rows), lambda: Pairs(lines.NEAR_AT_ONCE * rows + 1)
    most = lines.MET_AT_ONCE * rows
    assert lines._at_once(9, None, most, rows, few) and not lines._at_once(9, None, most, rows, many) and not lines._at_once(9, None, most + 1, rows, few)
    assert lines._at_once(95, 100, most + 1, rows, many) and not lines._at_once(90, 100, most + 1, rows, many)
