"""Language by nearest centroid, with rejection by distance.

A text is a vector of hashed letter n-grams (one to three letters, other characters as
one space), weighted by inverse document frequency and normalised. The vectors of each
language's training texts are clustered on the unit sphere, and a text gets the language of the
centroid with the largest cosine. It is rejected if that cosine is below what nearly all of
the centroid's own training texts reach, by a margin that is wider for short texts.

Learning uses a bounded sample; prediction reads every text in full, piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.common import in_bucket, table, text_key, unkeyed

DIMENSIONS = 4096
CLUSTERS = 4
#: Training texts of a language and of all together, in expectation; a text is drawn by a hash of its row.
SAMPLE = 600
SAMPLE_ALL = 6000
#: A text is rejected below MARGIN times the QUANTILE of its centroid's training cosines.
QUANTILE = 0.01
MARGIN = 0.5
#: Short texts lie far from every centroid: with n n-grams the floor is n / (n + SHORT) of that.
SHORT = 100.0
UNDETERMINED = "und"
#: Code points that are turned into n-grams at a time.
PIECE = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)], dtype=bool)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams; None if the text is null or has no letter."""
    if not text:
        return None
    counts, any_letter = np.zeros(DIMENSIONS, np.int64), False
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE].lower()
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _letters()[np.minimum(code, 0xFFFF)]
        if code.size and code.max() > 0xFFFF:
            letter = letter.copy()
            for i in np.flatnonzero(code > 0xFFFF):
                letter[i] = chr(code[i]).isalpha()
        if not letter.any():
            continue
        any_letter = True
        code = np.where(letter, code, np.uint32(32))
        code = code[letter | np.r_[True, letter[:-1]]]  # one space for each run of others
        mixed = code * np.uint32(2654435761)
        two = mixed[:-1] ^ (code[1:] * np.uint32(2246822519))
        three = two[:-1] ^ (code[2:] * np.uint32(3266489917))
        for seed, h in ((1, mixed), (2, two), (3, three)):
            h = (h + np.uint32(seed * 374761393)) * np.uint32(668265263)
            h ^= h >> np.uint32(15)
            counts += np.bincount((h * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    return counts if any_letter else None


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def spherical_clusters(rows: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and each row's cluster; starts from rows chosen farthest first, so reruns agree."""
    seeds = [int(np.argmax(rows @ _unit(rows.mean(axis=0, keepdims=True))[0]))]
    nearest = rows @ rows[seeds[0]]
    while len(seeds) < min(k, len(rows)):
        seeds.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, rows @ rows[seeds[-1]])
    centroids = rows[seeds]
    for _ in range(rounds):
        of = np.argmax(rows @ centroids.T, axis=1)
        centroids = _unit(np.stack([rows[of == j].mean(axis=0) if (of == j).any() else centroids[j] for j in range(len(centroids))]))
    return centroids, np.argmax(rows @ centroids.T, axis=1)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    floors: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts).astype(np.float32) * self.idf)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine within 0 to 1, rejected) for each text."""
        out: list[tuple[str, float, bool]] = [(UNDETERMINED, 0.0, True)] * len(texts)
        if not self.languages:
            return out
        for at in range(0, len(texts), 256):
            made = [(i, c) for i, t in enumerate(texts[at : at + 256], at) if (c := ngram_counts(t)) is not None]
            if made:
                counts = np.stack([c for _, c in made])
                cosines = self.vectors(counts) @ self.centroids.T
                best, n = np.argmax(cosines, axis=1), counts.sum(axis=1)
                floors = self.floors[best] * n / (n + SHORT)
                for (i, _), j, row, floor in zip(made, best, cosines, floors, strict=True):
                    out[i] = (self.languages[j], float(min(1.0, max(0.0, row[j]))), bool(row[j] < floor))
        return out


def fit(docs: DataFrame, allowed: Column) -> Model:
    """Learns from the rows of docs with text and lang for which ``allowed`` holds.

    At most SAMPLE texts of each language and SAMPLE_ALL in all are drawn, in expectation.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & allowed)
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = max(8, min(SAMPLE, SAMPLE_ALL // max(1, len(sizes))))
    known = docs.sparkSession.createDataFrame(
        [(k, min(1.0, each / n)) for k, n in sizes.items()], "lang string, share double"
    )
    drawn = F.pmod(F.xxhash64(F.lit("language"), "doc_id", text_key()), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = (
        usable.select("doc_id", "text", "lang")
        .join(F.broadcast(known), "lang")
        .where(drawn < F.col("share"))
        .select("lang", F.xxhash64("doc_id", "text").alias("key"), "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, key, text in zip(*batch.columns, strict=True):
                counts = ngram_counts(text.as_py())
                if counts is not None:
                    packed = np.minimum(counts, 0xFFFF).astype("<u2").tobytes()
                    yield pa.RecordBatch.from_pydict(
                        {"lang": [lang.as_py()], "key": [key.as_py()], "counts": pa.array([packed], pa.binary())}
                    )

    rows = picked.mapInArrow(run, "lang string, key long, counts binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["key"]))
    if not rows:
        return Model(np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), [], np.zeros(0))
    counts = np.stack([np.frombuffer(r["counts"], dtype="<u2") for r in rows])
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors = _unit(np.log1p(counts.astype(np.float32)) * idf)
    names = np.array([r["lang"] for r in rows])
    centroids, languages, floors = [], [], []
    for name in sorted(set(names)):
        own = vectors[names == name]
        found, of = spherical_clusters(own, CLUSTERS)
        for j, c in enumerate(found):
            if (of == j).any():
                centroids.append(c)
                languages.append(str(name))
                floors.append(MARGIN * float(np.quantile(own[of == j] @ c, QUANTILE)))
    return Model(idf, np.stack(centroids).astype(np.float32), languages, np.array(floors))


def predictor(model: Model):
    """Column function: text -> struct<lang_pred, score, rejected>."""

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        found = model.predict(texts.to_pylist())
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
            ["lang_pred", "score", "rejected"],
        )

    return predict


def held_out() -> Column:
    return in_bucket(F.col("doc_id"), 4, 2)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), one row for each row of docs.

    lang_pred is the language of the nearest centroid, also where it is rejected; a text that is
    null or without a letter is "und" with score 0 and rejected, and so is every text if there was
    nothing to learn from. Ties go to the first language by name; a null doc_id is not
    held out; only doc_id and text are looked at.
    """
    found = docs.select("doc_id", held_out().alias("held_out"), predictor(model)(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose language is rejected; columns and their order are those of docs.

    Null and empty texts and those without a letter are rejected, repeated rows all stay or all go; where nothing was learned all go. An empty
    table stays empty. Any column names may be there but __leafline_lang.
    """
    judged = docs.withColumn("__leafline_lang", predictor(model)(F.col("text")))
    return unkeyed(judged.where(~F.col("__leafline_lang.rejected")), docs)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trained = ~in_bucket(F.col("doc_id"), 4, 2) & F.col("doc_id").isNotNull()
    return identify(docs.select("doc_id", "text"), fit(docs, trained))
