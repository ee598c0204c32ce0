"""Fuzzy line deduplication, in DataFrame functions only.

Lines are lower-cased; ASCII letters and all other characters beyond ASCII make words. Lines of equal words are
one node. Two nodes are linked if their edit similarity in words is SIMILARITY or more, and of each connected group
the first occurrence stays.

Candidates come from a pigeonhole argument on the words: an edit touches at most two couples of neighbouring words,
so of the first 2 e + 1 couples of a line in any order common to all lines, e the edits allowed, a similar line
has one. Couples of long words come first, which are rare. All of them are entered, however long the line, so no
similar pair is lost.
The pairs of a code that survive a test of lengths and of the sets of words, which no similar pair fails, are read
again and compared, but for those that are in one group by then.

Bits of a SimHash as blocks were tried first and can't give the right results: fingerprints of lines that differ in a fifth of their words
differ in ten bits of 64 or more, so that blocks long enough to tell lines apart (32 bits) find a quarter of the similar pairs.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.common import KEY, checkpointed, components, decision_key, keyed, remove_path, scratch, stored, stored_at, table, text_key

#: Lines of fewer words are never touched.
MIN_WORDS = 5
#: Least edit similarity, in percent: 1 - distance / longer length, both in words.
SIMILARITY = 80
#: Lines of a code up to which they are compared in pairs at once.
CROWD = 64
#: Rounds of comparing the nodes outside the largest group of a crowded code with some inside, and how many.
STAR_ROUNDS, HEADS = 2, 4
#: Rows of crowded codes, times this: pairs up to which their sets of words are compared without such rounds, and near ones among them up to which all are read.
MET_AT_ONCE, NEAR_AT_ONCE = 256, 16
#: Codes, lines to be read again and lines to be cut up to which they are broadcast (at most some 100 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Turns in which codes are counted and met, and many pairs compared, so that shuffle files hold that share of them at once.
TURNS = 4
#: Pairs up to which their strings are shuffled at once.
PAIRS_AT_ONCE = 100_000
#: Words are told apart by 56 bits, the order of their lengths stands above.
WORD_BITS = (1 << 56) - 1
#: Columns of a set of words, each of one half of all words.
WIDE = ("p0", "p1")
#: Spark's setting for shuffle files of a query that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Makes a couple differ from its reverse.
TURN = 0x5A5A5A5A5A5A5A


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the query that wrote them, as each is run once; else they stay until the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once; Spark repeats a projected expression in each place that names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(line: Column) -> Column:
    """The normalised words of a line; lower case leaves no A-Z, so they need no place in the pattern."""
    return F.array_remove(F.split(F.lower(line), r"[\x00-\x60\x7B-\x7F]+"), "")


def _allowed(n: Column) -> Column:
    """Edits that leave a line of n words, the longer of two, similar enough."""
    return F.floor(n * (100 - SIMILARITY) / 100).cast("int")


def _node(w: Column) -> Column:
    return F.xxhash64(w)


def _keys(w: Column) -> Column:
    """A long for each word: its hash, less its length in bytes on top."""
    length = lambda x: F.least(F.octet_length(x), F.lit(63)).cast("long")
    return F.transform(w, lambda x: F.xxhash64(x).bitwiseAND(F.lit(WORD_BITS)) - F.shiftleft(length(x), 56))


def _couples(keys: Column) -> Column:
    """A long for each two words in a row, least for the longest, and the greatest long at the end; no nulls, which sort slowly."""
    following = F.slice(keys, F.lit(2), F.size(keys))
    return F.zip_with(keys, following, lambda a, b: F.coalesce(a.bitwiseXOR(F.lit(TURN)) + b, F.lit((1 << 63) - 1)))


def _presence(keys: Column, part: int) -> Column:
    """58 bits, from the seventh on; each word of that half sets one, but for one word in eleven, whose bit falls out."""
    half = F.bitwise_not if part == 0 else lambda k: k
    own = lambda k: F.call_function("shiftleft", half(k).bitwiseAND(F.lit(64)), k.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseOR(own(k)))


def marked_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, node, n, p0, p1, codes) of the lines of MIN_WORDS words or more.

    A line of n words and a similar one of m, where m >= n, share all but n - m + 2 floor(0.2 m) couples of the
    former, which is 2 floor(0.2 n) at most, and one more if the next length allows one more edit. The codes are the first
    of them in order, one more than that.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("text_key"), "text")
    place = ["doc_id", "text_key", "line_no"]
    split = rows.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    read = split.select(*place, _words(F.col("line")).alias("w"))
    keys = read.select(*place, F.size("w").alias("n"), _node(F.col("w")).alias("node"), _keys(F.col("w")).alias("k"))
    n = F.col("n")
    entered = F.greatest(2 * _allowed(n), 2 * _allowed(n + 1) - 1) + 1  # less than n, so the end of the couples stays out
    wide = [_presence(F.col("k"), i).alias(p) for i, p in enumerate(WIDE)]
    made = keys.select(*place, "n", "node", *wide, F.slice(F.sort_array(_couples(F.col("k"))), F.lit(1), entered).alias("codes"))
    long = F.when(n >= MIN_WORDS, F.struct("node", "n", *WIDE, "codes"))  # not where(), which would be tried on words of its own
    return made.select(*place, F.explode(F.array_compact(F.array(long))).alias("m")).select(*place, "m.*")


def shared_codes(places: DataFrame, turn: int = 0, turns: int = 1) -> DataFrame:
    """(code, node, n, p0, p1, k): the codes of places (node, n, p0, p1, codes) that lines of several nodes have; k is how many lines.

    Lines of a node repeat its codes, so a code is shared if its least and greatest nodes differ; nothing is dealt by node for that.
    Only the codes of that turn of so many are looked at.
    """
    entered = places.select("node", "n", *WIDE, F.explode("codes").alias("code"))
    entered = entered.where(F.pmod("code", F.lit(turns)) == turn) if turns > 1 else entered
    counts = entered.groupBy("code").agg(F.count("*").alias("k"), F.min("node").alias("low"), F.max("node").alias("high"))
    counts = stored(counts.where("low != high").select("code", "k"))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    return entered.join(counts, "code")


def _near(x: str, y: str) -> Column:
    """Do lengths and words of two lines allow enough similarity? Each edit takes one word from a line's set at most."""
    allowed = _allowed(F.greatest(f"n_{x}", f"n_{y}"))

    def lost(p: str, q: str) -> Column:
        return reduce(add, [F.bit_count(F.col(f"{c}_{p}").bitwiseAND(F.bitwise_not(F.col(f"{c}_{q}")))) for c in WIDE])

    apart = F.abs(F.col(f"n_{x}") - F.col(f"n_{y}"))
    return (apart <= allowed) & (lost(x, y) <= allowed) & (lost(y, x) <= allowed)


def _side(rows: DataFrame, name: str, *more: str) -> DataFrame:
    return rows.select("code", *[F.col(c).alias(f"{c}_{name}") for c in ("n", *WIDE, *more)], F.col("node").alias(name))


def _met(places: DataFrame, turn: int, turns: int, crowd: int) -> DataFrame:
    """Near pairs (a, b) of the codes of that turn; a node of a code with more than ``crowd`` lines is a row (code, a, n, p0, p1) instead.

    Nodes of a code of few lines meet in one array; those of others are dealt one by one.
    """
    shared = shared_codes(places, turn, turns)
    one = F.when(F.col("k") > crowd, F.col("node")).alias("one")
    groups = shared.groupBy("code", one).agg(F.collect_set(F.struct("node", "n", *WIDE)).alias("m"))
    side = lambda v: [F.col(f"{v}.node").alias(v), *[F.col(f"{v}.{c}").alias(f"{c}_{v}") for c in ("n", *WIDE)]]
    lone = F.col("one").isNotNull()
    each = groups.select("code", "one", F.when(~lone, F.col("m")).alias("m"), F.explode("m").alias("a")).select("code", "one", "m", *side("a"))
    both = each.select("*", F.explode_outer("m").alias("b")).select("code", "one", *[c for c in each.columns if c not in ("code", "one", "m")], *side("b"))
    kept = both.where(lone | ((F.col("a") < F.col("b")) & _near("a", "b")))
    return kept.select(F.when(lone, F.col("code")).alias("code"), "a", "b", *[F.when(lone, F.col(f"{c}_a")).alias(c) for c in ("n", *WIDE)])


def _coded(hashes: Column, turn: int) -> Column:
    """A string with one character for each word, 20 bits of its hash beyond U+FFFF, which are two halves of ten bits in UTF-16."""
    bits = lambda h: (F.shiftrightunsigned(h, 32) if turn else h).bitwiseAND(F.lit(0x3FF03FF)).bitwiseOR(F.lit(0xD800DC00))
    return F.decode(F.unhex(F.array_join(F.transform(hashes, lambda h: F.hex(bits(h))), "")), "UTF-16BE")


def line_strings(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, n, x, y) of nodes (node, place), read again from their documents; x and y are the words under two codings."""
    at = nodes.select("node", "place.*")
    places = at.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("line_no", "node")).alias("__places"))
    wanted = places.select(*decision_key(), "__places")
    wanted = F.broadcast(wanted) if nodes.count() <= BROADCAST_ROWS else wanted
    held = keyed(docs.select("doc_id", "text")).join(wanted, KEY)
    cut = lambda lines: F.transform("__places", lambda p: F.struct(p["node"].alias("node"), F.get(lines, p["line_no"]).alias("line")))
    found = held.select(F.explode(_let(F.split("text", "\n"), cut)).alias("l")).select("l.node", "l.line")
    hashes = found.select("node", F.transform(_words(F.col("line")), lambda x: F.xxhash64(x)).alias("h"))
    h = F.col("h")
    coded = hashes.select("node", F.size(h).alias("n"), _coded(h, 0).alias("x"), _coded(h, 1).alias("y"))
    coded = stored(coded)
    again = coded.count() > nodes.count()  # a document that comes again gives its lines again
    return coded.dropDuplicates(["node"]) if again else coded


def similar(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) whose line_strings have enough edit similarity; words count as equal if 40 bits of their hashes are.

    The second coding goes only to pairs that the first lets pass. Many pairs are compared in turns, as each carries a string.
    """
    if pairs.count() <= PAIRS_AT_ONCE:
        return _similar(pairs, own)
    turns = [pairs.where(F.pmod(F.xxhash64("a"), F.lit(TURNS)) == turn) for turn in range(TURNS)]
    return reduce(DataFrame.unionByName, [stored(_similar(part, own)) for part in turns])


def _similar(pairs: DataFrame, own: DataFrame) -> DataFrame:
    left, allowed = pairs.select("a", "b"), _allowed(F.greatest("n_a", "n_b"))
    for coding in ("x", "y"):
        a, b = [own.select(F.col("node").alias(v), F.col("n").alias(f"n_{v}"), F.col(coding).alias(f"s_{v}")) for v in ("a", "b")]
        both = left.join(a, "a").join(b, "b").withColumn("allowed", allowed)
        left = both.where("levenshtein(s_a, s_b, allowed) >= 0").select("a", "b")
    return left


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _read(nodes: DataFrame, places: DataFrame, docs: DataFrame) -> DataFrame:
    """line_strings of nodes, each at its first place."""
    wanted = stored(nodes)
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    first = F.min(F.struct("doc_id", "text_key", "line_no")).alias("place")
    return line_strings(stored(places.join(wanted, "node").groupBy("node").agg(first)), docs)


def _compared(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Links (a, b) with the groups of the similar ones of pairs (a, b, shared).

    A node is first compared with that which shares most codes with it. Most pairs of a family are in one group after that; the others are compared.
    """
    best = F.max(F.struct("shared", "a", "b")).alias("p")
    chosen = pairs.select("*", F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(best).select("p.a", "p.b").distinct()
    chosen = stored(chosen)
    links = checkpointed(similar(chosen, own))
    rooted = stored(components(links))
    root = lambda v: rooted.select(F.col("node").alias(v), F.col("root").alias(f"root_{v}"))
    told = pairs.join(chosen, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
    apart = stored(told.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    return checkpointed(links.unionByName(similar(apart, own)))


def similar_links(places: DataFrame, docs: DataFrame, crowd: int = CROWD, turns: int = TURNS) -> DataFrame:
    """Links (a, b) with the groups of all similar pairs of nodes that share a code; places are marked_lines.

    Nodes of a code with more than ``crowd`` lines are first compared with the least. What that links is one group, so from then
    on only nodes outside a code's largest group are compared: with HEADS of that group in each of STAR_ROUNDS rounds,
    which takes in most of a family of near copies, then with all that are still apart, so that no pair between groups is lost.
    Rounds are left out where few pairs are near anyway, and after one that took in less than a tenth of what was outside.
    """
    with scratch(docs.sparkSession):  # links are cut by checkpoints, so nothing that is stored here is read later
        return _linked(_all_met(places, turns, crowd), places, docs)


def _all_met(places: DataFrame, turns: int, crowd: int) -> DataFrame:
    return reduce(DataFrame.unionByName, [stored(_met(places, turn, turns, crowd)) for turn in range(turns)])


def _at_once(left: int, before: int | None, most: float, rows: int, met: Callable[[], DataFrame]) -> bool:
    """Are all pairs that are still apart to be compared now? ``left`` nodes are outside, ``before`` were a round ago, ``most`` is how many pairs meet."""
    if before is not None and 10 * left > 9 * before:
        return True
    return most <= MET_AT_ONCE * rows and met().count() <= NEAR_AT_ONCE * rows


def _linked(met: DataFrame, places: DataFrame, docs: DataFrame) -> DataFrame:
    many = stored(met.where("code IS NOT NULL").select("code", F.col("a").alias("node"), "n", *WIDE))
    least = _side(many.groupBy("code").agg(F.min(F.struct("node", "n", *WIDE)).alias("h")).select("code", "h.*"), "a")
    stars = _side(many, "b").join(least, "code").where((F.col("a") != F.col("b")) & _near("a", "b")).select("a", "b")
    pairs = stored(stars.unionByName(met.where("code IS NULL").select("a", "b")).groupBy("a", "b").agg(F.count("*").alias("shared")))
    own = _read(_ends(pairs), places, docs)
    links = _compared(pairs, own)
    if many.isEmpty():
        return links
    rows, apart, before, last = many.count(), (F.col("root_a") != F.col("root_b")) & _near("a", "b"), None, False
    for turn in range(STAR_ROUNDS + 1):
        with scratch(docs.sparkSession):
            known = stored(many.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")))
            sizes = known.groupBy("code", "root").agg(F.count("*").alias("m"))
            largest = sizes.groupBy("code").agg(F.max(F.struct("m", "root")).alias("l"), F.sum("m").alias("all"))
            largest = stored(largest.select("code", F.col("l.root").alias("head"), "all", (F.col("all") - F.col("l.m")).alias("out")))
            left, most = largest.agg(F.sum("out"), F.sum((F.col("out") * F.col("all")).cast("double"))).first()
            told = known.join(largest.select("code", "head"), "code")
            outside = stored(told.where("root != head").drop("head"))
            met = lambda others: _side(outside, "a", "root").join(_side(others, "b", "root"), "code").where(apart)  # noqa: B023, E731
            last = turn == STAR_ROUNDS or _at_once(left, before, most, rows, lambda: met(known))  # noqa: B023
            others, before = known, left
            if not last:
                ones = [F.min_by(F.struct("node", "n", "root", *WIDE), F.xxhash64("node", F.lit(HEADS * turn + i))) for i in range(HEADS)]
                others = told.where("root = head").groupBy("code").agg(F.array_distinct(F.array(*ones)).alias("h"))
                others = others.select("code", F.explode("h").alias("h")).select("code", "h.*")
            pairs = stored(met(others).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
            if not pairs.isEmpty():
                links = checkpointed(links.unionByName(similar(pairs, _read(_ends(pairs), places, docs))))
        if last:
            break
    return links


def similar_lines(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text_key, line_no) of every line that is not the first of its group; groups join all pairs of similar lines."""
    spark = docs.sparkSession
    marked, path = stored_at(marked_lines(docs))
    places = stored(marked.select("doc_id", "text_key", "line_no", "node"))
    with scratch(spark):  # as in similar_links, but the codes, most of what is stored, go when they have met
        met = _all_met(marked, TURNS, crowd)
        remove_path(spark, path)
        links = _linked(met, places, docs)
    rooted = components(links)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "line_no")
    grouped = places.select("node", place.alias("place")).join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = grouped.groupBy("root").agg(F.min("place").alias("kept"), F.max("place").alias("last")).where("kept != last")
    out = grouped.join(firsts.drop("last"), "root").where("place != kept")
    return out.select("place.doc_id", "place.text_key", "place.line_no").distinct()


def dedup_lines(docs: DataFrame, repeats: Callable[[DataFrame], DataFrame] = similar_lines) -> DataFrame:
    """docs with repeated lines cut from the text, and n_lines and n_removed beside the columns.

    Lines end at "\\n"; those of fewer than MIN_WORDS words stay. A null text has no
    lines and stays null, an empty one has one empty line. Occurrences are ordered by doc_id (nulls
    last), then a hash of the text and the line's number; rows equal in doc_id and text are one
    document, so both keep the same lines. Columns keep their order; columns that are named
    n_lines or n_removed are replaced, names that start with __leafline are reserved. ``repeats`` finds the repeated lines. An empty table gives an empty result.
    """
    with _tidy(docs.sparkSession):
        repeated = stored(repeats(docs))
    cut = repeated.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("__leafline_cut")).select(*decision_key(), "__leafline_cut")
    cut = F.broadcast(cut) if repeated.count() <= BROADCAST_ROWS else cut
    rows = keyed(docs).join(cut, KEY, "left")
    gone = F.col("__leafline_cut")
    left = lambda lines: F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(gone.isNull(), F.col("text")).otherwise(_let(F.split("text", "\n"), left)).alias("text")
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    counts = [
        F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    ]
    kept = [text if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return rows.select(*kept, *counts)


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
