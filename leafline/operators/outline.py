"""Embedded outlines: a gate that compares them with detected titles, and their trees.

The gate works entry by entry: an entry that wraps all others is taken off, service entries and those without a
title on the page go, and what is left decides about the outline. A document's titles are an array beside its entries if they are
few. Of more, an entry and a title are only compared if they share a word that one of them needs and lie within a page of each
other; nothing pairs all entries with many titles of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafline.functions.text import WHITE, normalise_title
from leafline.store import stored

# Titles of entries that are no sections, and what an outline of page anchors begins its titles with.
SERVICE = [
    "abstract", "keywords", "contents", "table of contents", "list of figures", "list of tables", "acknowledgments",
    "acknowledgements", "cover",
]
PAGE_ANCHOR = "page "
#: Share of the shorter title's words that two titles have in common, in percent.
OVERLAP = 70
#: Titles of a document up to which its entries are compared with them as one array.
FEW = 64

FULL, TITLES_ONLY, REJECT = "full", "titles_only", "reject"


def _words(norm: Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm, f"{WHITE}+"), lambda w: F.length(w) > 1))


def pruned(entries: DataFrame) -> DataFrame:
    """entries (doc_id, entry_no, title, level, page) with norm, of which only those stay that can be sections.

    A single entry of level 0 above others is taken off, the others rise by a level. Columns unwrapped and n_service tell
    what was done in the document. An entry with a null title is kept and matches nothing; a null page is unknown.
    """
    doc = W.partitionBy("doc_id")
    norm = normalise_title(F.coalesce("title", F.lit(""))).alias("norm")
    known = entries.select("doc_id", "entry_no", "title", "level", F.coalesce("page", F.lit(-1)).alias("page"), norm)
    counted = known.withColumn("__top", F.count_if(F.col("level") == 0).over(doc)).withColumn("__n", F.count("*").over(doc))
    lone = (F.col("__top") == 1) & (F.col("__n") > 1)
    open_ = counted.withColumn("unwrapped", lone).where(~(lone & (F.col("level") == 0)))
    open_ = open_.withColumn("level", F.col("level") - lone.cast("int"))
    service = F.col("norm").isin(SERVICE)
    out = open_.withColumn("__service", service).withColumn("n_service", F.count_if("__service").over(doc))
    return out.drop("__top", "__n")


def _alike(norm: Column, words: Column, title: Column, title_words: Column) -> Column:
    """Are two titles equal, or share they most of the shorter one's words?"""
    least = F.least(F.size(words), F.size(title_words))
    return ((norm == title) & (norm != "")) | ((least > 0) & (100 * F.size(F.array_intersect(words, title_words)) >= OVERLAP * least))


def with_hits(entries: DataFrame, titles: DataFrame, tolerance: int = 1, few: int = FEW) -> DataFrame:
    """entries of pruned with hit: has an entry that is no service one a title, by the rules of matched?

    Entries meet the titles of a document with up to ``few`` of them as one array, so they are dealt by document once and none is
    repeated; only documents with more go through matched.
    """
    large = stored(titles.groupBy("doc_id").agg(F.count("*").alias("k")).where(F.col("k") > few).select("doc_id"))
    none = large.isEmpty()
    norm = normalise_title(F.coalesce("title", F.lit("")))
    known = titles if none else titles.join(large, "doc_id", "left_anti")
    known = known.select("doc_id", norm.alias("norm"), F.coalesce("page", F.lit(-1)).alias("page")).where("norm != ''")
    title = F.struct("norm", "page", _words(F.col("norm")).alias("words"))
    listed = known.groupBy("doc_id").agg(F.collect_list(title).alias("__titles"))
    page = F.col("page")

    def fits(t: Column) -> Column:
        near = (page < 0) | (t["page"] < 0) | (F.abs(page - t["page"]) <= tolerance)
        return near & _alike(F.col("norm"), F.col("__words"), t["norm"], t["words"])

    small = entries if none else entries.join(large, "doc_id", "left_anti")
    both = small.withColumn("__words", _words(F.col("norm"))).join(listed, "doc_id", "left")
    hit = ~F.col("__service") & F.coalesce(F.exists("__titles", fits), F.lit(False))
    out = both.withColumn("hit", hit).drop("__words", "__titles")
    if none:
        return out
    rest = entries.join(large, "doc_id", "left_semi")
    found = matched(rest.where("NOT __service"), titles.join(large, "doc_id", "left_semi"), tolerance).withColumn("hit", F.lit(True))
    return out.unionByName(rest.join(found, ["doc_id", "entry_no"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))))


def _keys(rows: DataFrame, name: str, pages: Column) -> DataFrame:
    """rows with a page key of each and their words: as a whole, and as many as must hold one of the common ones."""
    size = F.size("words")
    needed = size - F.ceil(size * OVERLAP / 100).cast("int") + 1
    of = F.col("doc_id").alias("doc_id")
    return rows.select(of, F.col(name), "norm", "words", F.explode(pages).alias("place"), needed.alias("needed"))


def matched(entries: DataFrame, titles: DataFrame, tolerance: int = 1) -> DataFrame:
    """(doc_id, entry_no) of entries (doc_id, entry_no, norm, page) that have a title (doc_id, title, page) of equal or mostly common words.

    Pages agree if they are within the tolerance or one is unknown (null or below 0). Of the shorter title's words, a share of OVERLAP is
    common, so any of them but that many leave at least one: those, the rarest first, meet all words of the other side.
    """
    left = entries.select("doc_id", "entry_no", "norm", "page", _words(F.col("norm")).alias("words"))
    norm = normalise_title(F.coalesce("title", F.lit("")))
    right = titles.select("doc_id", norm.alias("norm"), F.coalesce("page", F.lit(-1)).alias("page")).where("norm != ''").distinct()
    right = right.withColumn("words", _words(F.col("norm"))).withColumn("title_no", F.xxhash64("norm", "page"))
    near = F.transform(F.sequence(-F.lit(tolerance), F.lit(tolerance)), lambda d: F.col("page") + d)
    unknown, any_ = F.lit(-1), F.lit(-2)  # below 0 no page is known, so these keys are free
    left = _keys(left, "entry_no", F.when(F.col("page") < 0, F.array(any_)).otherwise(F.concat(F.array(unknown), F.filter(near, lambda p: p >= 0))))
    right = _keys(right, "title_no", F.when(F.col("page") < 0, F.array(unknown, any_)).otherwise(F.array(F.col("page"), any_)))
    seen = right.select("doc_id", "title_no", F.explode("words").alias("word")).distinct().groupBy("doc_id", "word").agg(F.count("*").alias("df"))

    def every(rows: DataFrame) -> DataFrame:
        return rows.withColumn("word", F.explode(F.concat("words", F.array(F.concat(F.lit("="), "norm")))))

    def rarest(rows: DataFrame, name: str) -> DataFrame:
        spread = rows.withColumn("word", F.explode("words")).join(seen, ["doc_id", "word"])  # a word that no title has joins nothing
        absent = F.col("size") - F.count("*").over(W.partitionBy("doc_id", name, "place"))
        nth = F.row_number().over(W.partitionBy("doc_id", name, "place").orderBy("df", "word"))
        return spread.withColumn("size", F.size("words")).withColumn("nth", nth + absent).where("nth <= needed").drop("nth", "size", "df")

    def side(rows: DataFrame, name: str, tag: str) -> DataFrame:
        return rows.select("doc_id", "place", "word", F.col(name), F.col("norm").alias(f"norm_{tag}"), F.col("words").alias(f"words_{tag}"))

    key = ["doc_id", "place", "word"]
    equal = every(left).where("word = concat('=', norm)")
    one = side(rarest(left, "entry_no").unionByName(equal.drop("size"), allowMissingColumns=True), "entry_no", "a").join(side(every(right), "title_no", "b"), key)
    other = side(every(left), "entry_no", "a").join(side(rarest(right, "title_no"), "title_no", "b"), key)
    pairs = one.select("doc_id", "entry_no", "norm_a", "words_a", "norm_b", "words_b").unionByName(other.select("doc_id", "entry_no", "norm_a", "words_a", "norm_b", "words_b"))
    fits = _alike(*[F.col(c) for c in ("norm_a", "words_a", "norm_b", "words_b")])
    return pairs.where(fits).select("doc_id", "entry_no").distinct()


def gate(docs: DataFrame, entries: DataFrame, titles: DataFrame, tolerance: int = 1) -> tuple[DataFrame, DataFrame]:
    """(verdicts, kept) for docs (doc_id).

    verdicts are (doc_id, verdict, n_entries, n_matched, match_rate, notes), kept the entries (doc_id, entry_no, title, level, page) of outlines
    that are not rejected. full: titles and levels can be trusted; titles_only: more than three entries, all on one level; reject: no
    outline, nothing after pruning, page anchors, fewer than half or two of the entries matched, or pages that go back. Entries are ordered
    by entry_no, which a document has once. Documents that docs lacks have no verdict.
    """
    told = with_hits(pruned(entries), titles, tolerance).withColumn("anchor", F.col("norm").startswith(PAGE_ANCHOR))
    rows = stored(told.drop("norm"))  # read for the verdicts and for what is kept, so that titles are compared once
    section, order = ~F.col("__service"), W.partitionBy("doc_id", F.col("hit") & (F.col("page") >= 0)).orderBy("entry_no")
    falls = F.col("hit") & (F.col("page") >= 0) & F.coalesce(F.col("page") < F.lag("page").over(order), F.lit(False))
    per = rows.withColumn("falls", falls).groupBy("doc_id").agg(
        F.count_if(section).alias("n_entries"),
        F.count_if("hit").alias("n_matched"),
        F.count_if(section & F.col("anchor")).alias("anchors"),
        F.max("unwrapped").alias("unwrapped"),
        F.max("n_service").alias("n_service"),
        F.max("falls").alias("falls"),
        F.countDistinct(F.when(F.col("hit"), F.col("level"))).alias("levels"),
    )
    n, hits = F.col("n_entries"), F.col("n_matched")
    stages = [
        (n.isNull(), REJECT, "absent"),
        (n == 0, REJECT, "nothing after prune"),
        (F.col("anchors") >= F.greatest(F.lit(3), F.floor(n / 2)), REJECT, "page anchors"),
        ((2 * hits < n) | (hits < 2), REJECT, "too few entries match"),
        (F.col("falls"), REJECT, "pages go back"),
        ((F.col("levels") == 1) & (hits > 3), TITLES_ONLY, "flat levels"),
    ]
    reached = F.lit(len(stages))
    for i in reversed(range(len(stages))):
        reached = F.when(stages[i][0], i).otherwise(reached)
    verdict = F.get(F.array(*[F.lit(s[1]) for s in stages], F.lit(FULL)), F.col("stage"))
    lost = F.concat(F.lit("pruned "), n - hits, F.lit(" unmatched entries"))
    notes = F.array_compact(
        F.array(
            F.when(F.col("unwrapped"), F.lit("unwrapped single root")),
            F.when(F.col("n_service") > 0, F.concat(F.lit("pruned "), "n_service", F.lit(" service entries"))),
            F.when((F.col("stage") > 2) & (n > hits), lost),
            F.get(F.array(*[F.lit(s[2]) for s in stages], F.lit(None)), F.col("stage")),
        )
    )
    told = docs.select("doc_id").join(per, "doc_id", "left").withColumn("stage", reached)
    rate = F.when(F.col("stage") > 2, hits / n).otherwise(F.lit(0.0))
    verdicts = told.select(
        "doc_id", verdict.alias("verdict"), F.coalesce(n, F.lit(0)).alias("n_entries"), F.coalesce(hits, F.lit(0)).alias("n_matched"),
        rate.alias("match_rate"), notes.alias("notes"),
    )
    good = verdicts.where(F.col("verdict") != REJECT).select("doc_id")
    kept = rows.where("hit").join(good, "doc_id", "left_semi").select("doc_id", "entry_no", "title", "level", "page")
    return verdicts, kept


def outline_tree(entries: DataFrame) -> DataFrame:
    """(doc_id, entry_no, title, level, parent_no, depth, is_leaf) of entries (doc_id, entry_no, title, level): their tree.

    The parent is the nearest entry before with a lower level, null at the top; levels may be of any depth and skip.
    One pass over a document's entries in order carries the chain of open ones.
    """
    item = F.struct("entry_no", "title", "level")
    listed = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    link = entries.select(F.struct("entry_no", "level").alias("x")).schema["x"].dataType.simpleString()
    row = f"struct<entry_no:{dict(entries.dtypes)['entry_no']},parent_no:{dict(entries.dtypes)['entry_no']},depth:int>"

    def step(state: Column, x: Column) -> Column:
        above = F.filter(state["open"], lambda o: o["level"] < x["level"])
        own = F.struct(x["entry_no"].alias("entry_no"), F.get(above, F.size(above) - 1)["entry_no"].alias("parent_no"), F.size(above).alias("depth"))
        mine = F.array(F.struct(x["entry_no"].alias("entry_no"), x["level"].alias("level")))
        return F.struct(F.concat(above, mine).alias("open"), F.concat(state["told"], F.array(own)).alias("told"))

    start = F.struct(F.array().cast(f"array<{link}>").alias("open"), F.array().cast(f"array<{row}>").alias("told"))
    walked = listed.withColumn("told", F.aggregate("items", start, step)["told"])
    both = walked.select("doc_id", F.explode(F.arrays_zip("items", "told")).alias("r"))
    flat = both.select("doc_id", "r.items.entry_no", "r.items.title", "r.items.level", "r.told.parent_no", "r.told.depth")
    follows = F.lead("depth").over(W.partitionBy("doc_id").orderBy("entry_no"))
    return flat.withColumn("is_leaf", ~F.coalesce(follows > F.col("depth"), F.lit(False)))
