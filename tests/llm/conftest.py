import pytest

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "b"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "b"),  # a repeated row
    (3, "", None, None),
    (4, None, "en", "a"),
    (None, "no id but some words of text here to look at", "fr", None),
    (5, "   \n\t ", "de", "a"),
    (6, "é" * 5 + " 12345 !!! ###", "fr", "c"),
    (7, "word " * 3000, "en", "a"),
    (8, "\n".join(["the same line of eight words stands here"] * 4), "en", "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows and clashing extra columns."""
    rows = [(*r, len(r[1] or ""), 1, "x", 0.5) for r in ROWS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, size string, `key` double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def benchmark(spark):
    rows = [(1, "quick brown fox"), (2, None), (3, ""), (None, "lazy dog"), (10, "over the lazy dog near"), (10, "over the lazy dog near")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def vectors(spark):
    """Nulls in every column and component, non-finite, zero and too short vectors, ties, repeated rows and clashing extra columns."""
    inf, nan = float("inf"), float("nan")
    good = [(i, [float((i * k) % 7) / 8 - 0.3 for k in range(1, 9)], i % 3) for i in range(0, 400, 4)]
    odd = [(900, None, 1), (901, [], 1), (902, [nan] * 8, 1), (903, [inf] + [0.0] * 7, None), (904, [None] + [0.5] * 7, 0)]
    odd += [(905, [0.0] * 8, None), (906, [0.1, 0.2], 2), (None, [0.25] * 8, 2), (100, [0.5] * 8, None), (100, [0.5] * 8, None), (200, good[50][1], 0)]
    rows = [(*r, "x", 0.5) for r in good + odd]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, score double").repartition(3)


@pytest.fixture(scope="session")
def tables(spark, odd, benchmark, labels, vectors, tmp_path_factory):
    """The odd tables as a folder that the registered queries read."""
    folder = tmp_path_factory.mktemp("tables")
    odd.write.parquet(f"{folder}/documents.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    vectors.write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def prose(spark):
    """Documents with planted near copies, from a small vocabulary."""
    import random

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    texts += [t + " " + rng.choice(vocabulary) for t in texts[:40]] + texts[:20]
    for _ in range(60):  # a group of near copies of one long text
        words = texts[0].split() * 12
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}" if i % 11 else None, len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
