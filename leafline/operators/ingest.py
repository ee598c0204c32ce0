"""From detected blocks to documents: levels of headings by stages, text under headings, trees as markdown, grouped assets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafline.functions.parsing import tiebreak_of
from leafline.functions.text import normalise_title, strip
from leafline.operators.layout import MAX_LEVEL, heading_levels, typography_levels
from leafline.operators.prune import drop_empty
from leafline.operators.tree import with_ancestors

# Headings of grouped assets.
ICONS = "Likely icons/broken infographics"
BOTH, TABLES, FIGURES = "Figures and tables", "Tables", "Figures"
LEFTOVER = "Figures and Tables"


def ladder(docs: DataFrame, headings: DataFrame, outlines: DataFrame | None = None, replies: DataFrame | None = None, share: float = 0.8) -> DataFrame:
    """(doc_id, rung, gate_share, headings) of docs (doc_id): how far up the ladder a document's headings had to go.

    headings are (doc_id, n, title, size, weight), outlines (doc_id, verdict, entries array of (title, level)), replies (doc_id, reply)
    of a model that is only heard where too few levels are sure. -1: no headings; 0: a full outline; 1: numbering; 2: fonts; 4: the reply;
    5: a reply that can't be used or none. The result's headings are (n, title, level, confidence, signal) in order; a document
    of rung -1 has none.
    """
    induced = heading_levels(headings.select("doc_id", "n", "title"))
    filled = typography_levels(headings.join(induced, ["doc_id", "n"]))
    of_font = F.when(F.col("calibrated"), F.lit("med")).otherwise(F.lit("low"))
    sure = F.when(F.col("signal") == "marker", F.col("confidence")).when(F.col("signal") == "typography", of_font).otherwise(F.lit("none"))
    item = F.struct(F.col("n").cast("int").alias("n"), "title", F.col("level").cast("int").alias("level"), sure.alias("confidence"), "signal")
    per = filled.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(item)).alias("own"),
        F.avg(sure.isin("high", "med").cast("int")).alias("gate_share"),
        F.max(F.col("signal") == "typography").alias("typed"),
    )
    out = docs.select("doc_id").join(per, "doc_id", "left")
    none = F.lit(None)
    if outlines is None:
        out = out.withColumn("entries", none.cast("array<struct<title:string,level:int>>"))
    else:
        out = out.join(outlines.where("verdict = 'full'").select("doc_id", "entries"), "doc_id", "left")
    replied = none.cast("array<int>") if replies is None else tiebreak_of("reply", F.coalesce(F.size("own"), F.lit(0)))
    out = (out if replies is None else out.join(replies, "doc_id", "left")).withColumn("replied", replied)
    resolved = F.lit(True) if replies is None else F.col("gate_share") >= share
    rung = (
        F.when(F.col("own").isNull(), -1)
        .when(F.col("entries").isNotNull(), 0)
        .when(resolved, F.when(F.col("typed"), 2).otherwise(1))
        .otherwise(F.when(F.col("replied").isNotNull(), 4).otherwise(5))
    )

    def row(n, title, level, confidence, signal):
        return F.struct(
            n.cast("int").alias("n"), title.alias("title"), level.cast("int").alias("level"), confidence.alias("confidence"), signal.alias("signal")
        )

    of_outline = F.transform("entries", lambda e, i: row(i, e["title"], e["level"] + 1, F.lit("high"), F.lit("outline")))
    of_reply = F.zip_with("own", "replied", lambda h, level: row(h["n"], h["title"], level, F.lit("med"), F.lit("reply")))
    chosen = F.when(F.col("rung") == 0, of_outline).when(F.col("rung") == 4, of_reply).otherwise(F.col("own"))
    return out.withColumn("rung", rung).select("doc_id", "rung", F.round("gate_share", 3).alias("gate_share"), chosen.alias("headings"))


def content_tree(blocks: DataFrame) -> DataFrame:
    """The tree of blocks (doc_id, n, page, y0, is_title, level, text), n in reading order; text only in leaves.

    (doc_id, node_seq, title, heading_level, is_leaf, synthetic, content, depth, ancestors, breadcrumb). A title without a level is text.
    Text belongs to the title before it, joined by spaces. Text before the first title, and above the highest title of page 0, goes; a document
    without titles is one leaf without a title. An inner node's text becomes a first child of the same title. Nodes
    with no text below go. Levels beyond MAX_LEVEL count as that.
    """
    head = F.col("is_title") & F.col("level").isNotNull()
    whole, so_far = W.partitionBy("doc_id"), W.partitionBy("doc_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    marked = (
        blocks.withColumn("head", head)
        .withColumn("section", F.last(F.when(F.col("head"), F.col("n")), ignorenulls=True).over(so_far))
        .withColumn("headed", F.max("head").over(whole))
        .withColumn("top", F.min(F.when(F.col("head") & (F.col("page") == 0), F.col("y0"))).over(whole))
    )
    front = F.col("headed") & (F.col("section").isNull() | F.coalesce((F.col("page") == 0) & (F.col("y0") < F.col("top")), F.lit(False)))
    body = marked.where(~F.col("head") & ~front).withColumn("text", strip("text")).where("text != ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda b: b["text"]), " ")
    own = body.groupBy("doc_id", "section").agg(joined.alias("own"))
    heads = marked.where("head").select("doc_id", "section", F.col("text").alias("title"), F.least("level", F.lit(MAX_LEVEL)).cast("int").alias("level"))
    inner = F.coalesce(F.lead("level").over(W.partitionBy("doc_id").orderBy("section")) > F.col("level"), F.lit(False))
    full = heads.join(own, ["doc_id", "section"], "left").withColumn("inner", inner)
    plain = own.where("section IS NULL").select(
        "doc_id", "section", F.lit(None).cast("string").alias("title"), F.lit(1).alias("level"), "own", F.lit(False).alias("inner")
    )

    def node(part: int, level, leaf, content):
        return F.struct(
            F.lit(part).alias("part"), "title", level.alias("heading_level"), leaf.alias("is_leaf"), F.lit(part == 1).alias("synthetic"), content.alias("content")
        )

    real = node(0, F.col("level"), ~F.col("inner"), F.when(~F.col("inner"), F.col("own")))
    pushed = node(1, F.col("level") + 1, F.lit(True), F.col("own"))
    both = F.when(F.col("inner") & F.col("own").isNotNull(), F.array(real, pushed)).otherwise(F.array(real))
    rows = full.unionByName(plain).select("doc_id", "section", F.explode(both).alias("x")).select("doc_id", "section", "x.*")
    numbered = rows.withColumn("node_seq", F.row_number().over(W.partitionBy("doc_id").orderBy("section", "part")) - 1)
    return drop_empty(with_ancestors(numbered.drop("section", "part")))


def tree_markdown(tree: DataFrame, titles: DataFrame | None = None, assets: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown) of a content_tree: the document's title on top, sections from "##" down by depth.

    titles are (doc_id, doc_title). A leaf titled as its parent has no heading of its own. assets are (doc_id, n, title, link): a link stands once, under
    the first leaf of its title, or at the end if there is none. A document is one row, so it has to fit into a task.
    """
    top = tree.sparkSession.createDataFrame([], "doc_id string, doc_title string") if titles is None else titles
    above = tree.select("doc_id", F.col("node_seq").alias("up"), F.col("title").alias("up_title"))
    rows = tree.withColumn("up", F.get("ancestors", F.lit(0))).join(above, ["doc_id", "up"], "left").join(top, "doc_id", "left")
    rows = rows.withColumn("up_title", F.coalesce("up_title", "doc_title", F.lit("")))
    silent = F.col("title").isNull() | (F.col("is_leaf") & (normalise_title("title") == normalise_title("up_title")))
    hashes = F.repeat(F.lit("#"), F.least(F.col("depth") + 2, F.lit(MAX_LEVEL)))
    line = F.array_compact(
        F.array(F.when(~silent, F.concat(hashes, F.lit(" "), "title", F.lit("\n"))), F.when(F.col("is_leaf"), F.concat("content", F.lit("\n"))))
    )
    place = lambda part, at, n: [F.lit(part).alias("part"), at.alias("at"), n.alias("n")]
    pieces = rows.select("doc_id", F.posexplode(line).alias("i", "line"), "node_seq")
    pieces = pieces.select("doc_id", *place(1, F.col("node_seq"), F.col("i")), "line")
    if assets is not None:
        leaves = rows.where("is_leaf").select("doc_id", normalise_title("title").alias("key"), "node_seq")
        keyed = assets.withColumn("key", normalise_title("title")).join(leaves, ["doc_id", "key"], "left")
        once = keyed.groupBy("doc_id", "link").agg(F.min("node_seq").alias("node_seq"), F.min("n").alias("n"))
        lost = once.where("node_seq IS NULL")
        heading = lost.select("doc_id").distinct().select("doc_id", *place(2, F.lit(0), F.lit(0)), F.lit(f"## {LEFTOVER}\n").alias("line"))
        link = F.concat("link", F.lit("\n")).alias("line")
        under = once.where("node_seq IS NOT NULL").select("doc_id", *place(1, F.col("node_seq"), F.col("n") + 2), link)
        pieces = pieces.unionByName(under).unionByName(heading).unionByName(lost.select("doc_id", *place(2, F.lit(1), F.col("n")), link))
    if titles is not None:
        held = titles.where("doc_title != ''").join(tree.select("doc_id").distinct(), "doc_id")
        pieces = pieces.unionByName(held.select("doc_id", *place(0, F.lit(0), F.lit(0)), F.concat(F.lit("# "), "doc_title", F.lit("\n")).alias("line")))
    ordered = F.array_sort(F.collect_list(F.struct("part", "at", "n", "line")))
    return pieces.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["line"]), "\n").alias("markdown"))


def asset_groups(assets: DataFrame) -> DataFrame:
    """assets (doc_id, section, level, n, type, is_icon) with group, the heading that they stand under, and heading_level.

    All icons of a section share one leaf at heading_level, below the section's level. One other asset stands there by itself, with a null
    group; several stand a level below a common heading.
    """
    section = W.partitionBy("doc_id", "section")
    real = ~F.col("is_icon")
    tables = F.count_if(real & (F.col("type") == "table")).over(section)
    kinds = F.size(F.collect_set(F.when(real, F.col("type"))).over(section))
    n = F.count_if(real).over(section)
    label = F.when(kinds > 1, F.lit(BOTH)).when(tables > 0, F.lit(TABLES)).otherwise(F.lit(FIGURES))
    group = F.when(F.col("is_icon"), F.lit(ICONS)).when(n > 1, label)
    below = F.when(real & (n > 1), 2).otherwise(1)
    return assets.withColumn("group", group).withColumn("heading_level", F.least(F.col("level") + below, F.lit(MAX_LEVEL)))
