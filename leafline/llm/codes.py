"""Compression of vectors to short codes: product quantisation, its codebooks trained by Yinyang Lloyd in whole numbers.

Components become integers, vectors are cut into equal parts, and each part position has a codebook. A Lloyd round assigns each part to the
nearest entry and moves each entry to the floored mean of its parts. Entries are clustered into groups
once. Each row carries an upper bound of the distance to its own entry and one lower bound for each group,
all other entries counted. When entries move, the bounds are shifted by how far they went, for a group by its
fastest; a row whose upper bound stays below all its lower bounds keeps its entry, others compute their own
distance anew and scan only the groups whose bound fails.

Bounds are rounded outwards, so only a group that is strictly farther is left out. Distances that are compared are squares of
integers, computed in doubles below 2^53, which is exact: ties are real and go to the lower index.

Rows stay where they are. A round is one pass that writes codes and bounds to the shared folder and one that adds up
the parts of each entry within its task; only those sums, of one codebook's size for each task, are shuffled, and only
codebooks and their sums come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.common import finite_vectors, remove_path, stored_at, table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Entries for each group of a codebook, about.
GROUP = 16
#: Rounds of clustering entries into groups; any groups are right, better ones spare more scans.
GROUP_ROUNDS = 5
#: Squared distances stay below this, so that doubles hold them exactly.
EXACT = 1 << 53
#: What bounds are moved outwards by, against the rounding of roots.
SLACK = 1e-6
#: Groups of labels whose sums are broadcast.
BROADCAST_ROWS = 100_000


def integers(values: np.ndarray) -> np.ndarray:
    """Components as whole numbers, in doubles."""
    return np.floor(SCALE * values.astype(np.float64))


def _exact(x: np.ndarray) -> np.ndarray:
    """x, if all distances among such rows fit; else an error rather than a wrong result."""
    if x.size and 4.0 * x.shape[-1] * np.abs(x).max() ** 2 >= EXACT:
        raise ValueError("components are too large for exact distances")
    return x


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries; every intermediate value is a whole number below EXACT."""
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None]


def clustered(book: np.ndarray) -> list[np.ndarray]:
    """Indexes of entries by group, each ascending: a few rounds of plain Lloyd over the entries themselves."""
    n = max(1, round(len(book) / GROUP))
    centres = book[np.linspace(0, len(book) - 1, n).astype(int)]
    for _ in range(GROUP_ROUNDS):
        own = distances(book, centres).argmin(1)
        centres = np.stack([book[own == g].mean(0) if (own == g).any() else centres[g] for g in range(n)])
    return [m for g in range(n) if len(m := np.flatnonzero(own == g))]


@dataclass
class Bounds:
    """What rows carry for one part: their entry, at most how far it is, and at least how far any other entry of each group is."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def assign(x: np.ndarray, book: np.ndarray, groups: list[np.ndarray], bounds: Bounds | None, moved: np.ndarray | None) -> tuple[Bounds, int]:
    """The nearest entries (ties: the lower index) and their bounds, from those before entries ``moved``; and how many groups were scanned."""
    n, scanned = len(x), 0
    if bounds is None:
        code, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, len(groups)))
    else:
        code = bounds.code.astype(np.int64)
        upper = bounds.upper.astype(np.float64) + moved[code]
        lower = bounds.lower.astype(np.float64) - np.array([moved[g].max() for g in groups])[None]
    open_ = np.flatnonzero(upper >= lower.min(1))
    square = ((x[open_] - book[code[open_]]) ** 2).sum(1)
    upper[open_] = np.sqrt(square)
    still = upper[open_] + SLACK >= lower[open_].min(1)
    rows, best = open_[still], square[still]
    before, old = code[rows].copy(), best.copy()
    group_of = np.zeros(len(book), np.int64)
    for g, members in enumerate(groups):
        group_of[members] = g
    nearest = code[rows].copy()
    first = np.full((len(rows), len(groups)), -1)  # by scanned group: its nearest entry, its distance and the second one's
    d1, d2 = np.full(first.shape, np.inf), np.full(first.shape, np.inf)
    for g, members in enumerate(groups):
        near = np.flatnonzero(lower[rows, g] <= np.sqrt(best) + SLACK)
        scanned += len(near)
        if not len(near):
            continue
        d = distances(x[rows[near]], book[members])
        at = d.argmin(1)
        every = np.arange(len(near))
        first[near, g], d1[near, g] = members[at], d[every, at]
        d[every, at] = np.inf
        d2[near, g] = d.min(1)
        better = (d1[near, g] < best[near]) | ((d1[near, g] == best[near]) & (first[near, g] < nearest[near]))
        take = near[better]
        best[take], nearest[take] = d1[take, g], first[take, g]
    seen = first >= 0
    least = np.where(first == nearest[:, None], d2, d1)
    lower[rows] = np.where(seen, np.sqrt(least), lower[rows])
    left = np.flatnonzero((nearest != before) & ~seen[np.arange(len(rows)), group_of[before]])
    home = (rows[left], group_of[before[left]])  # the entry that was left counts for its group again
    lower[home] = np.minimum(lower[home], np.sqrt(old[left]))
    code[rows], upper[rows] = nearest, np.sqrt(best)
    outward = Bounds(
        code.astype(np.uint16),
        np.nextafter((upper + SLACK).astype(np.float32), np.float32(np.inf)),
        np.nextafter((lower - SLACK).astype(np.float32), np.float32(-np.inf)),
    )
    return outward, scanned


@dataclass(frozen=True)
class Codebooks:
    """Entries by [part][entry, position], as whole numbers."""

    entries: list[np.ndarray]
    scale: int = SCALE

    def sha256(self) -> str:
        """Over all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(c)) for book in self.entries for c in book.ravel()).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Vectors that codes [row, part] stand for; components are the middle of their integer's range."""
        return np.concatenate([(book[codes[:, i]] + 0.5) / self.scale for i, book in enumerate(self.entries)], axis=1)


def _cuts(width: int, parts: int) -> list[slice]:
    edges = [width * i // parts for i in range(parts + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _pass(rows: DataFrame, books: list[np.ndarray], grouped: list[list[np.ndarray]], moved: list[np.ndarray] | None, keep: list[str]) -> DataFrame:
    """rows (keep, vector as binary integers, code, bounds) with new codes and bounds, and how many groups their batch has scanned."""
    cuts = _cuts(sum(b.shape[1] for b in books), len(books))
    width, wide = cuts[-1].stop, [1 + len(g) for g in grouped]
    edges = np.cumsum([0, *wide])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = {c: batch.column(c) for c in keep}
            x = _matrix(batch.column("v"), width, "<i4").astype(np.float64)
            new, spent = [], 0
            if moved is not None:
                codes, known = _matrix(batch.column("code"), len(books), "<u2"), _matrix(batch.column("bounds"), edges[-1], "<f4")
            for i, book in enumerate(books):
                bounds = None
                if moved is not None:
                    mine = known[:, edges[i] : edges[i + 1]]
                    bounds = Bounds(codes[:, i], mine[:, 0], mine[:, 1:])
                found, scanned = assign(_exact(x[:, cuts[i]]), book, grouped[i], bounds, moved[i] if moved is not None else None)
                new.append(found)
                spent += scanned
            code = np.stack([b.code for b in new], axis=1).astype("<u2")
            known_now = np.concatenate([np.concatenate([b.upper[:, None], b.lower], axis=1) for b in new], axis=1).astype("<f4")
            yield pa.RecordBatch.from_pydict(
                own
                | {
                    "v": batch.column("v"),
                    "code": pa.array([r.tobytes() for r in code], pa.binary()),
                    "bounds": pa.array([r.tobytes() for r in known_now], pa.binary()),
                    "scanned": pa.array([spent] + [0] * (len(code) - 1), pa.int64()),
                }
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(run, f"{kept}{', ' if kept else ''}v binary, code binary, bounds binary, scanned long")


def _sums(rows: DataFrame, sizes: list[int], cuts: list[slice]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By part: count and summed components of each entry's rows. Each task adds up its own first."""
    width = cuts[-1].stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((k, c.stop - c.start + 1), np.int64) for k, c in zip(sizes, cuts, strict=True)]
        for batch in batches:
            if batch.num_rows:
                x, codes = _matrix(batch.column("v"), width, "<i4"), _matrix(batch.column("code"), len(cuts), "<u2")
                for i, c in enumerate(cuts):
                    order = np.argsort(codes[:, i], kind="stable")
                    sorted_ = codes[order, i]
                    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
                    counted = np.concatenate([np.ones((len(x), 1), np.int64), x[order, c].astype(np.int64)], axis=1)
                    totals[i][sorted_[starts]] += np.add.reduceat(counted, starts, axis=0)
        for i, total in enumerate(totals):
            used = np.flatnonzero(total[:, 0])
            at = np.arange(total.shape[1])
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(np.full(used.size * at.size, i, np.int32)),
                    "entry": pa.array(np.repeat(used, at.size).astype(np.int32)),
                    "place": pa.array(np.tile(at, used.size).astype(np.int32)),
                    "total": pa.array(total[used].ravel()),
                }
            )

    found = rows.select("v", "code").mapInArrow(run, "part int, entry int, place int, total long")
    out = [np.zeros((k, c.stop - c.start + 1), np.int64) for k, c in zip(sizes, cuts, strict=True)]
    for r in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect():
        out[r["part"]][r["entry"], r["place"]] = r["total"]
    return [o[:, 0] for o in out], [o[:, 1:] for o in out]


def train(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    keep: list[str] | None = None,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    told: Callable[[int, int], None] = lambda number, scanned: None,
) -> tuple[DataFrame, Codebooks]:
    """(coded, codebooks): coded has key, the columns ``keep``, code (binary, two bytes a part) and error.

    Codebooks start as the parts of the first ``entries`` rows by key (nulls last, ties by the vector's components), fewer if there
    are fewer; all rows count in each round. Rows whose vector is null or holds null or non-finite components are
    dropped, and so are those of another length than the first row's. Where the length isn't a multiple of ``parts``, parts
    differ by one component. Repeated rows count as often as they stand. An empty table gives empty codebooks and no rows.
    Components of more than some 2^23 / sqrt(length) in integers are an error. told(round, groups scanned) is called after each round.
    """
    spark = rows.sparkSession
    keep = [key, *(keep or [])]
    good, order, width = finite_vectors(rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, vector])]), key, vector)
    seeds = [r[0] for r in good.orderBy(*order).limit(entries).select(vector).collect()]
    first = _exact(integers(np.array(seeds, np.float64).reshape(len(seeds), width)))
    cuts = _cuts(width, parts)
    books = [first[:, c] for c in cuts]
    types = {f.name: f.dataType.simpleString() for f in good.schema}
    if not seeds:
        empty = ", ".join(f"`{c}` {types[c]}" for c in keep)
        return spark.createDataFrame([], f"{empty}, code binary, error long"), Codebooks(books)
    grouped = [clustered(b) for b in books]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((batch.num_rows, 0))
            whole = _exact(integers(flat)).astype("<i4")
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {"v": pa.array([r.tobytes() for r in whole], pa.binary())})

    packed = good.mapInArrow(pack, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", v binary")
    now, path = stored_at(_pass(packed, books, grouped, None, keep))
    for number in range(1, rounds + 1):
        told(number, now.agg(F.sum("scanned")).first()[0])
        counts, totals = _sums(now, [len(b) for b in books], cuts)
        new = [np.where(n[:, None] > 0, t // np.maximum(n, 1)[:, None], b).astype(np.float64) for n, t, b in zip(counts, totals, books, strict=True)]
        moved = [np.sqrt(((a - b) ** 2).sum(1)) for a, b in zip(new, books, strict=True)]
        books = new
        later, later_path = stored_at(_pass(now, books, grouped, moved, keep))
        remove_path(spark, path)
        now, path = later, later_path
    told(rounds + 1, now.agg(F.sum("scanned")).first()[0])
    return _measured(now, books, cuts, keep), Codebooks(books)


def _measured(rows: DataFrame, books: list[np.ndarray], cuts: list[slice], keep: list[str]) -> DataFrame:
    """The rows' codes, and their squared distance to what the codes stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, codes = _matrix(batch.column("v"), cuts[-1].stop, "<i4").astype(np.float64), _matrix(batch.column("code"), len(cuts), "<u2")
            error = sum(((x[:, c] - books[i][codes[:, i]]) ** 2).sum(1) for i, c in enumerate(cuts))
            kept = {c: batch.column(c) for c in [*keep, "code"]}
            yield pa.RecordBatch.from_pydict(kept | {"error": pa.array(error.astype(np.int64))})

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in [*keep, "code"])
    return rows.select(*[F.col(f"`{c}`") for c in [*keep, "v", "code"]]).mapInArrow(run, f"{types}, error long")


def hex_code(code: str = "code", parts: int = PARTS) -> Column:
    """Two hex digits a part, of codes below 256."""
    return F.concat(*[F.lower(F.hex(F.substring(code, 2 * i + 1, 1))) for i in range(parts)])


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = train(table(spark, sf_dir, "embeddings"), keep=["label"])
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    by_label = sums.select(F.col("label").alias("of_label"), "label_error")
    by_label = F.broadcast(by_label) if sums.count() <= BROADCAST_ROWS else by_label
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", hex_code().alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
