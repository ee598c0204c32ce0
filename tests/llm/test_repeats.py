"""Periodic runs against every period tried at every place."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafline.llm import repeats
from leafline.llm.queries import QUERIES


def plain(words, exponent, least):
    n, found = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(exponent * p, least):
                found[i, j - i + p] = min(p, found.get((i, j - i + p), p))
            i = max(j, i + 1)
    return sorted((*k, p) for k, p in found.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 6), st.integers(0, 30), st.lists(st.integers(0, 3), max_size=8))
def test_all_runs(head, period, more, tail):
    symbols = head + [(head or [0])[i % period % max(1, len(head))] for i in range(more)] + tail
    for exponent, least in ((2, 2), (2, 5), (3, 3), (4, 6)):
        expected = plain(symbols, exponent, least)
        assert repeats.all_runs(symbols, exponent, least) == expected
        assert repeats.runs_of([str(s).encode() for s in symbols], exponent, least) == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=30))
def test_factors(symbols):
    text, at = list(map(str, symbols)), 0
    for start, length, earlier in repeats.factors(symbols):
        assert start == at
        starts = [i for i in range(start) if text[i : i + length] == text[start : start + length]]
        assert starts[:1] == ([earlier] if earlier >= 0 else [])
        longer = length + (earlier >= 0)
        assert start + longer > len(text) or not any(text[i : i + longer] == text[start : start + longer] for i in range(start))
        at += length
    assert at == len(symbols)


def test_long_texts():
    rng = random.Random(3)
    words = [b"%d" % rng.randrange(400) for _ in range(3000)]
    words = words + words[:700] * 5 + [b"a"] * 2000 + words
    assert repeats.runs_of(words) == plain(words, 4, 6)
    assert repeats.collapsed([b"x"] * 100_000, repeats.runs_of([b"x"] * 100_000)) == [b"x"]


def made(doc_id, text):
    """The query's words, runs and digests, plainly."""
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words, 4, 6)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(((-length, s, p) for s, length, p in runs), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()
    rest = b" ".join(w for i, w in enumerate(words) if i not in gone)
    head = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *head, sha(lines), sha(rest))


def test_query(spark, tables, tmp_path):
    rng = random.Random(8)
    texts = [" \n".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["é x " * 9, "a b c " * 5, None, ""]
    spark.createDataFrame([*enumerate(texts), (None, "a " * 30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (tmp_path, tables):
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        got = [tuple(r) for r in QUERIES["op12_periodic_runs"](spark, str(folder)).collect()]
        assert sorted(got, key=str) == sorted((made(d.doc_id, d.text) for d in docs), key=str)
    assert sum(r[1] for r in map(tuple, QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect())) > 15


def test_collapse(spark, odd, none):
    got = {r.doc_id: r.text for r in repeats.collapse(odd).collect()}
    assert got[7] == "word" and got[4] is None and got[3] == "" and got[5] == "   \n\t "
    assert got[8].split() == "the same line of eight words stands here".split()
    assert repeats.collapse(odd).columns == odd.columns and repeats.collapse(none).collect() == []


@pytest.mark.parametrize("exponent, least, returns", [(4, 6, 3), (2, 2, 0), (3, 3, 1), (5, 4, 3)])
def test_least_returns(exponent, least, returns):
    assert repeats.least_returns(exponent, least) == returns


def test_whole_texts(spark):
    text = " ".join(str(i) for i in range(50_000)) + " z" * 8
    rows = spark.createDataFrame([(1, text, "a"), (2, None, "b")], "n_words long, text string, runs string")
    first, second = sorted(repeats.periodic_runs(rows, keep=()).collect(), key=lambda r: -r.n_words)
    assert first.n_words == 50_008 and [tuple(r) for r in first.runs] == [(50_000, 8, 1)] and first.collapsed.endswith("49999 z")
    assert tuple(second) == (0, [], None)
