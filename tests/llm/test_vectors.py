"""Codes against plain Lloyd, bounds against all distances, neighbours against all pairs."""

import hashlib

import numpy as np
import pytest

from leafline.llm import codes, neighbours
from leafline.llm.queries import QUERIES


def usable(rows):
    """(vec_id, vector, label) of rows that hold eight finite components, in order."""
    good = [r for r in rows if r[1] is not None and len(r[1]) == 8 and all(c is not None and np.isfinite(c) for c in r[1])]
    return sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def plain_codes(rows, parts=4, entries=256, rounds=4):
    x = np.floor(1024 * np.array([r[1] for r in rows], np.float32).astype(np.float64)).astype(np.int64)
    cut = np.split(x, parts, axis=1)
    books = [p[:entries].copy() for p in cut]
    apart = lambda p, b: ((p[:, None] - b[None]) ** 2).sum(2)
    for _ in range(rounds):
        for p, b in zip(cut, books, strict=True):
            own = apart(p, b).argmin(1)
            for e in set(own.tolist()):
                b[e] = p[own == e].sum(0) // (own == e).sum()
    d = [apart(p, b) for p, b in zip(cut, books, strict=True)]
    text = ",".join(str(c) for b in books for c in b.ravel())
    return np.stack([y.argmin(1) for y in d], 1), sum(y.min(1) for y in d), hashlib.sha256(text.encode()).hexdigest()


def test_codes_of_odd_rows(spark, tables):
    rows = usable([(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()])
    code, error, sha = plain_codes(rows)
    of_label = {}
    for r, e in zip(rows, error.tolist(), strict=True):
        of_label[r[2]] = of_label.get(r[2], 0) + e
    expected = [(r[0], "".join(f"{c:02x}" for c in k), e, of_label[r[2]], sha) for r, k, e in zip(rows, code.tolist(), error.tolist(), strict=True)]
    got = [tuple(r) for r in QUERIES["op11_vector_codes"](spark, tables).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and len(got) > 100


def test_training_is_plain_lloyd(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(3000, 16)), 2).astype(np.float32)  # coarse, so that there are ties
    x[500:1500] = x[7]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    scans = []
    coded, books = codes.train(frame, entries=64, told=lambda number, scanned: scans.append(scanned))
    code, error, sha = plain_codes([(i, v) for i, v in enumerate(x)], entries=64)
    got = sorted(coded.collect())
    assert books.sha256() == sha
    assert [np.frombuffer(r.code, "<u2").tolist() for r in got] == code.tolist() and [r.error for r in got] == error.tolist()
    assert scans[0] == 3000 * 4 * 4 and scans[-1] < scans[0] / 2  # later rounds scan only groups whose bound fails
    back = books.decode(code)
    assert np.abs(back - x).max() < 4 and (np.linalg.norm(back - x, axis=1) < np.linalg.norm(x - x.mean(0), axis=1)).mean() > 0.9


@pytest.mark.parametrize("seed", range(5))
def test_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-30, 30, (400, 4)).astype(float), rng.integers(-30, 30, (40, 4)).astype(float)
    groups, bounds, moved = codes.clustered(book), None, None
    assert sorted(np.concatenate(groups).tolist()) == list(range(40))
    for _ in range(4):
        bounds, _ = codes.assign(x, book, groups, bounds, moved)
        d = np.sqrt(codes.distances(x, book))
        assert (bounds.code == (d**2).round().argmin(1)).all() and (bounds.upper >= d[np.arange(400), bounds.code]).all()
        others = d.copy()
        others[np.arange(400), bounds.code] = np.inf
        assert all((bounds.lower[:, g] <= others[:, m].min(1)).all() for g, m in enumerate(groups))
        new = book + rng.integers(-4, 5, book.shape)
        book, moved = new, np.sqrt(((new - book) ** 2).sum(1))


def test_too_large_components_are_refused(spark):
    frame = spark.createDataFrame([(1, [3e30] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        codes.train(frame)


def plain_nearest(rows, queries, k=10, own=True):
    out = []
    x = np.array([r[1] for r in rows], np.float64)
    for q in queries:
        near = sorted((float(np.sqrt(((x[i] - np.array(q[1], np.float64)) ** 2).sum())), r[0] is None, r[0] or 0) for i, r in enumerate(rows))
        if own:
            near.remove((0.0, q[0] is None, q[0] or 0))
        out += [(q[0], i + 1, None if null else n, s) for i, (s, null, n) in enumerate(near[:k])]
    return out


def test_neighbours_of_odd_rows(spark, tables):
    rows = [r for r in usable([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]) if any(r[1])]
    expected = plain_nearest(rows, [r for r in rows if r[0] is not None and r[0] % 100 == 0])
    got = [tuple(r) for r in QUERIES["op13_hashed_neighbours"](spark, tables).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_every_code_within_the_radius():
    rng = np.random.default_rng(4)
    codes_ = rng.integers(0, 256, (600, 8)).astype(np.uint8)
    codes_[100:300] = codes_[5]
    shard = neighbours.Shard(rng.normal(size=(600, 3)), np.arange(600), codes_)
    for i in (0, 5, 400):
        for candidates in (1, 20, 150, 450):
            apart = np.bitwise_count(codes_ ^ codes_[i]).sum(1)
            assert shard.within(codes_[i], candidates).tolist() == np.flatnonzero(apart <= np.sort(apart)[candidates - 1]).tolist()


def test_recall_and_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 1500)
    monkeypatch.setattr(neighbours, "BLOCK", 16)  # several blocks
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4500, 24)).astype(np.float32)
    x[3000:] = x[17]  # a third of the rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(2)
    index = neighbours.build(frame)
    got = [tuple(r) for r in neighbours.search(index, frame.where("vec_id % 100 = 0"), candidates=100, own=True).collect()]
    expected = plain_nearest([(i, v) for i, v in enumerate(x)], [(i, x[i]) for i in range(0, 4500, 100)])
    assert len(got) == len(expected) and len(set(got) & set(expected)) >= 0.9 * len(expected)
    exact = {r for r in expected if r[0] >= 3000}
    assert exact <= set(got)  # ties within the crowd go to the smaller ids
    other = neighbours.search(index, frame.where("vec_id = 3").selectExpr("vec_id", "embedding"), k=1)
    assert [(r.vec_id, r.score) for r in other.collect()] == [(3, 0.0)]
