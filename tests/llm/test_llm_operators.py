"""Operators against brute force, round trips and held-out accuracy."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leafline.llm import common, decontaminate, language, mixing, pii, quality, sharding, simhash, tokens


def groups(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("crowd", [simhash.CROWD, 1])
def test_simhash_components(spark, prose, crowd, monkeypatch):
    monkeypatch.setattr(simhash.close_pairs, "__defaults__", (crowd,))
    rows = prose.select("doc_id", "text").orderBy("doc_id").collect()
    fps = [plain_simhash(r.text) for r in rows]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    expected = groups(len(fps), links)
    got = {r.doc_id: r for r in simhash.near_duplicates(prose).collect()}
    assert [got[i].fp % 2**64 for i in range(len(fps))] == fps
    assert [got[i].component_id for i in range(len(fps))] == expected
    assert {r.doc_id for r in simhash.deduplicate(prose).collect()} == set(expected)


def test_simhash_blocks_do_not_matter(monkeypatch):
    text = " ".join(str(i) for i in range(500))
    whole = simhash.simhash(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.simhash(text) == whole == plain_simhash(text)


def test_components_of_a_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(150)] + [(order[160], order[161])], "a long, b long")
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert {got[n] for n in order[:151]} == {min(order[:151])}
    assert got[order[160]] == got[order[161]] == min(order[160:162])


def test_languages_held_out(spark):
    rng = random.Random(4)
    parts = {"aa": "ka lo mi tu".split(), "bb": "sch ung ein ich".split(), "cc": "eau oui tre ment".split()}

    def text(lang, n):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    rows = [(i, text(lang := list(parts)[i % 3], rng.randint(3, 40)), lang) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, ~language.held_out())
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    held = [r for r in rows if found[r[0]].held_out]
    assert held and np.mean([found[i].lang_pred == lang for i, _, lang in held]) > 0.97
    assert not any(r.rejected for r in found.values())
    far = "жзщф ыюяб " * 100
    assert model.predict([far, None, "12 !", ""])[0][2] and model.predict([None])[0] == ("und", 0.0, True)
    assert model.predict(["12 !", ""]) == [("und", 0.0, True)] * 2


def test_language_pieces_cover_the_text(monkeypatch):
    text = "abc déf " * 50
    whole = language.ngram_counts(text)
    monkeypatch.setattr(language, "PIECE", 64)
    assert abs(int(language.ngram_counts(text).sum()) - int(whole.sum())) < 40


def test_quality_held_out(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 60))]
        rows.append((i, ". ".join(words) if good else "".join(f"{w}### " for w in words)))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    forest = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r.doc_id: r for r in quality.scored(docs, forest).collect()}
    held = [i for i in out if out[i].held_out]
    assert held and np.mean([out[i].predicted == labels[i][1] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values())


def test_forest_walks_like_its_trees():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(400, 5))
    forest = quality.grow(rows, (rows[:, 0] + rows[:, 1] ** 2 > 0.5).astype(float))

    def walk(row):
        total = forest.base
        for t in range(quality.TREES):
            node = 0
            while node < 2**quality.DEPTH - 1:
                node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.threshold[t, node])
            total += forest.value[t, node - (2**quality.DEPTH - 1)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(rows), [walk(r) for r in rows])


def plain_contamination(texts, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = low(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(item)
    sizes = {len(w) for w in windows}
    for text in texts:
        w, hit, found = low(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        yield len(w), len(hit), len(found)


def test_contamination(spark, prose, monkeypatch):
    rows = prose.select("doc_id", "text").orderBy("doc_id").collect()
    items = [(i, " ".join(rows[i].text.split()[2:18])) for i in range(0, 60, 3)] + [(100, rows[5].text.split()[0]), (101, "É zz")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = list(plain_contamination([r.text for r in rows], items))
    for most in (decontaminate.BROADCAST_ROWS, 40):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(prose, bench).collect()}
        assert [got[i] for i in range(len(rows))] == expected
    kept = {r.doc_id for r in decontaminate.decontaminate(prose, bench).collect()}
    assert kept == {i for i, (n, hit, _) in enumerate(expected) if not (hit and 20 * hit >= n)}


def test_targets_reshare_what_is_above():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])
    assert mixing.targets([0, 0], [5, 2]) == [0, 0]


def test_mixture(spark, prose):
    rows = mixing.mixture(prose).collect()
    size, taken, target = collections.Counter(), collections.Counter(), {}
    sources = {r.doc_id: r.source for r in prose.collect()}
    for r in rows:
        s = sources[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 1 for s in size) and abs(sum(target.values()) - sum(size.values())) < 1e-6
    order = sorted((s for s in size if s is not None)) + [None]
    assert [target[s] for s in order] == pytest.approx(mixing.targets([size[s] for s in order], [5, 2, 1, 5, 2]))
    mixed = mixing.mix(prose).collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(taken.values())
    assert all(r.n_chars == len(r.text) for r in mixed)


def test_schedule_is_even(spark):
    plan = [("a", 10000, 6000.0, 6000, 100), ("b", 1000, 3000.0, 3000, 10)]
    rows = mixing.schedule(spark, plan, 100).orderBy("slot").collect()
    assert collections.Counter(r.source_no for r in rows) == {0: 60, 1: 30}
    for n in (9, 30, 60):
        assert abs(sum(r.source_no == 0 for r in rows[:n]) - n * 2 / 3) <= 2


def test_packing_is_lossless(spark, prose):
    rows = tokens.pack(prose, length=64, block_tokens=3000).collect()
    matrix, pieces = tokens.id_matrix(rows, 64), collections.defaultdict(list)
    for ids, r in zip(matrix, rows):
        assert r.position_resets == r.cu_seqlens[:-1] and r.cu_seqlens[-1] == r.n_tokens <= 64
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.piece_starts)):
            pieces[doc].append((start, ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]]))
    decode = tokens.encoding(tokens.TOKENIZER).decode
    for r in prose.collect():
        ids = np.concatenate([p for _, p in sorted(pieces[r.doc_id], key=lambda p: p[0])])
        assert ids[-1] == tokens.END_ID and decode(ids[:-1].tolist()) == r.text


def test_best_fit_decreasing_against_a_scan():
    rng = random.Random(6)
    for _ in range(200):
        length = rng.randint(1, 40)
        sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 50))]
        got = tokens.best_fit_decreasing(sizes, length)
        assert sorted(i for s in got for i in s) == list(range(len(sizes)))
        rooms = []
        for size in sorted(sizes, reverse=True):
            fits = [r for r in rooms if r >= size]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - size)
            else:
                rooms.append(length - size)
        assert sorted(length - sum(sizes[i] for i in s) for s in got) == sorted(rooms)


def test_long_texts_are_encoded_as_a_whole(monkeypatch):
    text = "some words, and  more\n\n words é " * 300 + "x" * 500
    whole = tokens.encode(text)
    monkeypatch.setattr(tokens, "PIECE", 100)
    assert (tokens.encode(text) == whole).all()


def test_spans_against_patterns():
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def fine(kind, t):
        digits = re.sub("[^0-9]", "", t)
        if kind == "ip":
            return all(int(x) <= 255 for x in t.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and pii.luhn(digits)
        return kind == "email" or 10 <= len(digits) <= 15

    rng = random.Random(8)
    samples = ["".join(rng.choice("0123459..--  @@++ab(é)") for _ in range(rng.randint(0, 40))) for _ in range(20000)]
    samples += ["4111 1111 1111 1111 x@y.z.example +1 (555) 555-0100 192.168.0.1.7"]
    for t in samples:
        expected = [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, t) if fine(k, m[0])]
        assert [s for s in pii.spans(t) if s[0] in kinds] == sorted(expected, key=lambda s: (s[1], list(kinds).index(s[0])))


def test_added_spans_and_redaction(spark):
    text = "ftp://me:pw@host.org and IBAN DE89370400440532013000, token = \"0123456789abcdef0123456789abcdef\""
    assert [s[0] for s in pii.spans(text) if s[0] not in pii.BASE] == ["login", "iban", "secret"]
    df = spark.createDataFrame([(1, "mail a@b.cc now"), (2, None), (3, "é +1 (555) 555-0100")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redact(df).collect()} == {1: "mail <email> now", 2: None, 3: "é <phone>"}


def test_differencing_balances():
    rng = random.Random(2)
    weights = [rng.randint(1, 10**6) for _ in range(3000)]
    sums = collections.Counter()
    for w, p in zip(weights, sharding.differencing(weights, 16)):
        sums[p] += w
    assert len(sums) == 16 and max(sums.values()) - min(sums.values()) < 100
    assert sharding.differencing([], 4) == [] and sorted(sharding.differencing([8, 7, 6, 5, 4], 2)) in ([0, 0, 0, 1, 1], [0, 0, 1, 1, 1])


def test_shards(spark, prose):
    rows = sharding.sharded(prose).collect()
    texts = {r.doc_id: r.text for r in prose.collect()}
    by_text, slots, sums = collections.defaultdict(set), collections.defaultdict(list), collections.Counter()
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1
        by_text[texts[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sums) == set(range(16)) and max(sums.values()) - min(sums.values()) <= max(r.size for r in rows)


def test_written_shards(spark, prose, tmp_path):
    sharding.write_shards(prose, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == prose.count() and back.select("shard").distinct().count() == 4


def test_mix_keeps_sources_apart(spark):
    text = "some words of one text that two sources have " * 3
    rows = [(1, text.strip(), "a"), (1, text.strip(), "b"), (2, "other words here", "b"), (None, None, None), (3, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = collections.Counter()
    for r in mixing.mixture(docs).collect():
        taken[r.source] += r.taken
    mixed = collections.Counter()
    for r in mixing.mix(docs).collect():
        mixed[r.source] += len(r.text.split())
    assert mixed == +taken


def plain_mixture(sized, plan, block):
    """taken of (source_no, key, size) rows in stream order: the schedule's slots walked one by one."""
    streams, edges, needed = collections.defaultdict(list), [], []
    for key, (source, size) in sized.items():
        streams[source] += [key] * size
    for _, size, _, quota, _ in plan:
        needed.append(quota // size * -(-size // block) + -(-(quota % size) // block) if size else 0)
    for i in range(len(plan) - 1):
        edges.append(sum(needed[: i + 1]) / sum(needed))
    taken, done, slot = collections.Counter(), [0] * len(plan), 0
    while any(d < n for d, n in zip(done, needed)):
        point = slot * mixing.PHI
        source = sum(e <= point - np.floor(point) for e in edges)
        slot += 1
        if done[source] < needed[source]:
            _, size, _, quota, blocks = plan[source]
            epoch, number = divmod(done[source], blocks)
            taken.update(streams[source][number * block : min(number * block + block, size, quota - epoch * size)])
            done[source] += 1
    return taken


def test_taken_is_what_the_schedule_takes(spark, prose):
    rows = prose.select("doc_id", "text", "source").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in mixing.mixture(prose).collect()}
    keyed = prose.select("doc_id", F.xxhash64(F.lit("mix"), "doc_id", "source", common.text_key("text")).alias("h"))
    order = sorted(keyed.collect(), key=lambda r: r.h % 2**64 >> 33)  # ranges first, then the signed hash
    names = sorted({r.source for r in rows if r.source is not None}) + [None]
    sizes = {n: sum(len(r.text.split()) for r in rows if r.source == n) for n in names}
    target = mixing.targets([sizes[n] for n in names], [mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i in range(len(names))])
    block = max(1, min(mixing.BLOCK_WORDS, sum(sizes.values()) // mixing.MIN_SLOTS))
    plan = [(n, sizes[n], t, min(round(t), 3 * sizes[n]), -(-sizes[n] // block)) for n, t in zip(names, target)]
    source = {r.doc_id: names.index(r.source) for r in rows}
    n_ranges = max(1, -(-len(rows) // mixing.RANGE_ROWS))
    order.sort(key=lambda r: ((r.h % 2**64 >> 33) * n_ranges >> 31, r.h))
    size = {r.doc_id: len(r.text.split()) for r in rows}
    expected = plain_mixture({r.doc_id: (source[r.doc_id], size[r.doc_id]) for r in order}, plan, block)
    assert {d: r.taken for d, r in got.items()} == {d: expected[d] for d in got}


def test_written_shards_of_repeated_rows(spark, tmp_path):
    rows = [(1, "same text", 7, "x")] * 5 + [(None, None, 8, "y"), (2, "", 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot string")
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(back) == 7 and len({(r.shard, r.slot) for r in back}) == 7
    assert len({r.shard for r in back if r.doc_id == 1}) == 1 and sorted(r.slot for r in back if r.doc_id == 1)[-1] >= 4


def plain_differencing(weights, k):
    """Sums of the parts, largest first: the two partitions of largest spread are joined, largest with least, until one is left."""
    parts = [sorted([w] + [0] * (k - 1), reverse=True) for w in weights]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1], reverse=True)
        a, b, *parts = parts
        parts.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    return parts[0] if parts else []


@pytest.mark.parametrize("k", [2, 3, 8])
def test_differencing_against_a_plain_one(k):
    rng = random.Random(k)
    for n in (1, 2, 5, 40):
        weights = rng.sample(range(1, 10**9), n)  # spreads without ties
        sums = [0] * k
        for w, p in zip(weights, sharding.differencing(weights, k)):
            sums[p] += w
        assert sorted(sums, reverse=True) == plain_differencing(weights, k)


def test_pii_columns_against_spans(spark, tmp_path):
    import hashlib

    from leafline.llm.queries import QUERIES

    texts = ["mail a.b@c.de now", None, "", "é +1 (555) 555-0100 and 10.0.0.255, 4111 1111 1111 1111", "x@y.z " * 50]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op8_pii"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == [0, 0, 1, 2, 3, 4]
    for r in out:
        every = pii.spans(texts[r.doc_id])
        found = [s for s in every if s[0] in pii.BASE]
        joined = lambda listed: ",".join(f"{k}:{a}:{b}" for k, a, b in listed)
        assert r.base_sha256 == hashlib.sha256(joined(found).encode()).hexdigest() and r.spans == joined(every)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in found) for k in pii.BASE]


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "a@b.cc", "s"), (1, "a@b.cc", "s"), (2, "", None), (None, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __spans string")
    out = pii.redact(docs)
    assert out.columns == docs.columns and pii.redact(docs.limit(0)).collect() == []
    expected = [(1, "<email>", "s"), (1, "<email>", "s"), (2, "", None), (None, None, "t")]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, expected))


def plain_stump(rows, labels):
    """Best single split of plain log-loss gain over all features and all values, by brute force."""
    p = labels.mean()
    gradient, weight = labels - p, p * (1 - p)
    best = (0.0, None)
    for f in range(rows.shape[1]):
        for cut in np.unique(rows[:, f])[:-1]:
            left = rows[:, f] <= cut
            gain = sum(gradient[side].sum() ** 2 / (weight * side.sum()) for side in (left, ~left))
            best = max(best, (gain, f))
    return best[1]


def test_first_split_is_the_best(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(600, 4))
    for f in range(4):
        labels = (rows[:, f] > 0.3).astype(float)
        assert quality.grow(rows, labels).feature[0, 0] == plain_stump(rows, labels) == f


def plain_ngrams(text):
    """Hashed counts of one to three letters, one character at a time."""
    kept, mask = [], 0xFFFFFFFF
    for c in (text or "").lower():
        if c.isalpha():
            kept.append(ord(c))
        elif not kept or kept[-1] != 32:
            kept.append(32)
    counts = collections.Counter()
    for i, code in enumerate(kept):
        h = code * 2654435761 & mask
        grams = [(1, h)]
        if i + 1 < len(kept):
            h ^= kept[i + 1] * 2246822519 & mask
            grams.append((2, h))
        if i + 2 < len(kept):
            h ^= kept[i + 2] * 3266489917 & mask
            grams.append((3, h))
        for n, g in grams:
            g = (g + n * 374761393 & mask) * 668265263 & mask
            g ^= g >> 15
            counts[(g * 2654435761 & mask) >> 20] += 1
    return counts if any(chr(c).isalpha() for c in kept) else None


def test_nearest_centroid_against_plain_cosines(spark):
    rng = random.Random(4)
    parts = {"aa": "ka lo mi tu".split(), "bb": "sch ung ein ich é".split(), "cc": "xo zy qua".split()}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(lang, rng.randint(2, 40)), lang) for i in range(120) for lang in [list(parts)[i % 3]]]
    rows += [(200, "12 34", "aa"), (201, None, "bb"), (202, text("aa", 9), None)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))

    learned = [(plain_ngrams(t), lang) for _, t, lang in rows if lang and plain_ngrams(t)]
    seen = collections.Counter(g for counts, _ in learned for g in counts)
    idf = [np.log((1 + len(learned)) / (1 + seen[g])) + 1 for g in range(language.DIMENSIONS)]
    assert np.allclose(model.idf, idf, atol=1e-5)

    def vector(counts):
        v = np.zeros(language.DIMENSIONS)
        for g, n in counts.items():
            v[g] = np.log1p(n) * idf[g]
        return v / np.sqrt(sum(x * x for x in v))

    nearest = collections.defaultdict(list)  # each centroid against the texts of its language that are nearest to it
    for counts, lang in learned:
        v = vector(counts)
        own = [j for j, name in enumerate(model.languages) if name == lang]
        nearest[max(own, key=lambda j: v @ model.centroids[j])].append(v)
    for j, centroid in enumerate(model.centroids):
        mean = np.mean(nearest[j], axis=0)
        assert np.allclose(centroid, mean / np.linalg.norm(mean), atol=0.02)
        assert np.isclose(model.floors[j], language.MARGIN * np.quantile([v @ centroid for v in nearest[j]], language.QUANTILE), atol=1e-4)

    asked = [t for _, t, _ in rows] + [text(lang, n) for lang in parts for n in (1, 5, 60)] + ["wwww vvvv", "日本語", "ä", "", "a" * 3000]
    for t, (lang, score, rejected) in zip(asked, model.predict(asked), strict=True):
        counts = plain_ngrams(t)
        if counts is None:
            assert (lang, score, rejected) == (language.UNDETERMINED, 0.0, True)
            continue
        cosines, n = [float(vector(counts) @ c) for c in model.centroids], sum(counts.values())
        best = int(np.argmax(cosines))
        floor = model.floors[best] * n / (n + language.SHORT)
        assert abs(score - min(1, max(0, cosines[best]))) < 1e-5
        assert lang == model.languages[best] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-5
        assert rejected == (cosines[best] < floor) or abs(cosines[best] - floor) < 1e-5


def test_first_tree_against_all_splits():
    """Every split and every leaf of the first tree, each found by trying all of them."""
    rng = np.random.default_rng(8)
    rows = np.round(rng.normal(size=(700, 3)), 1)
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.5)).astype(float)
    forest = quality.grow(rows, labels)
    p = labels.mean()
    gradient, hessian = labels - p, np.full(len(rows), p * (1 - p))
    gain = lambda g, h: g * g / (h + quality.RIDGE)
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for f in range(3)]
    inside, split = {0: np.ones(len(rows), bool)}, 0
    for node in range(2**quality.DEPTH - 1):
        at, best = inside[node], (1e-9, 0, np.inf)
        for f in range(3):
            for e in edges[f]:
                low = at & (rows[:, f] <= e)
                high = at & ~low
                if min(hessian[low].sum(), hessian[high].sum()) >= quality.LEAST_HESSIAN:
                    g = gain(gradient[low].sum(), hessian[low].sum()) + gain(gradient[high].sum(), hessian[high].sum()) - gain(gradient[at].sum(), hessian[at].sum())
                    best = max(best, (g, f, e), key=lambda b: round(b[0], 9))
        f, e = forest.feature[0, node], forest.threshold[0, node]
        assert (f, e) == best[1:]
        split += e < np.inf
        inside[2 * node + 1], inside[2 * node + 2] = at & ~(rows[:, f] > e), at & (rows[:, f] > e)
    assert split >= 3
    for leaf in range(2**quality.DEPTH):
        at = inside[leaf + 2**quality.DEPTH - 1]
        assert np.isclose(forest.value[0, leaf], quality.RATE * gradient[at].sum() / (hessian[at].sum() + quality.RIDGE))


def test_packed_files(spark, odd, none, tmp_path):
    packed = tokens.pack(odd)
    tokens.write_packed(packed, f"{tmp_path}/packed")
    back = spark.read.parquet(f"{tmp_path}/packed")
    assert sorted(map(str, back.collect())) == sorted(map(str, packed.collect())) and back.columns == packed.columns
    assert tokens.id_matrix(back.collect()).shape == (back.count(), tokens.LENGTH)
    tokens.write_packed(tokens.pack(none), f"{tmp_path}/none")
    assert spark.read.parquet(f"{tmp_path}/none").collect() == []
    with pytest.raises(Exception, match="already exists"):
        tokens.write_packed(packed, f"{tmp_path}/packed")


def test_values_of_odd_rows(spark, tables):
    """What the queries say about nulls, blanks, repeats and long texts, row by row."""
    import zlib

    from leafline.llm.queries import QUERIES

    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    by = lambda values: sorted(map(str, values))
    run = lambda name: QUERIES[name](spark, tables).collect()
    fps = [(d.doc_id, plain_simhash(d.text)) for d in docs]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i][1] ^ fps[j][1]).bit_count() <= 2]
    of = groups(len(fps), links)
    least = {g: min((fps[i][0] for i in range(len(fps)) if of[i] == g and fps[i][0] is not None), default=None) for g in of}
    assert by((r.doc_id, r.fingerprint, r.component_id) for r in run("op1_simhash_dedup")) == by((i, f"{fp:016x}", least[g]) for (i, fp), g in zip(fps, of, strict=True))
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert by((r.doc_id, r.lang_pred == "und") for r in run("op2_language_id")) == by((d.doc_id, not letters(d.text)) for d in docs)
    scored = run("op4_quality")
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    assert by((r.doc_id, r.held_out) for r in scored) == by((d.doc_id, held(d.doc_id)) for d in docs)
    size = lambda t: len((t or "").encode().split())
    whole = collections.Counter()
    for d in docs:
        whole[d.source] += size(d.text)
    assert by((r.doc_id, r.size, r.source_size) for r in run("op7_mix_sources")) == by((d.doc_id, size(d.text), whole[d.source]) for d in docs)
    assert {(r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in run("op8_pii")} == {(0, 0, 0, 0, "")}
    sharded = run("op10_shard_bytes")
    data = lambda t: (t or "").encode()
    assert by((r.doc_id, r.size, r.text_crc32) for r in sharded) == by((d.doc_id, len(data(d.text)) + 1, zlib.crc32(data(d.text))) for d in docs)
    slots = collections.defaultdict(list)
    for r in sharded:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
