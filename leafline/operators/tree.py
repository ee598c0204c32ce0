"""Headings to trees as flat tables.

A document's lines become headings, headings become nodes with the sequence number of
their parent, and the text under a heading becomes its own text. Everything is a
window over a document's lines in order; there is no recursion and no self-join. Node keys are
(doc_id, node_seq); node_id is an attribute, which may repeat within a document.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafline.functions.text import WHITE, slug, strip
from leafline.store import before

# What a heading line is, and below what a provenance fence is.
HEADING = r"^(#{1,6})[ \t\x0B\f\r]+(.+)$"
MAX_LEVEL = 6


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_idx, line); only "\\n" ends a line. A null text has none."""
    return docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_idx", "line"))


def headings(split: DataFrame) -> DataFrame:
    """(doc_id, line_idx, level, title, node_id) of heading lines, fenced ones included."""
    pattern = f"(?d){HEADING}"
    return with_node_ids(
        split.where(F.col("line").rlike(pattern)).select(
            "doc_id",
            "line_idx",
            F.length(F.regexp_extract("line", pattern, 1)).alias("level"),
            strip(F.regexp_extract("line", pattern, 2)).alias("title"),
        )
    )


def with_node_ids(heads: DataFrame) -> DataFrame:
    """heads with node_id, the title's slug; the second of a slug gets the suffix -2, the third -3 and so on."""
    nth = F.row_number().over(W.partitionBy("doc_id", "__slug").orderBy("line_idx"))
    named = heads.withColumn("__slug", slug("title")).withColumn("__nth", nth)
    suffixed = F.when(F.col("__nth") > 1, F.concat("__slug", F.lit("-"), "__nth")).otherwise(F.col("__slug"))
    return named.withColumn("node_id", suffixed).drop("__slug", "__nth")


def with_parents(heads: DataFrame) -> DataFrame:
    """heads with parent_line: the nearest heading before with a lower level, null at the top."""
    before = W.partitionBy("doc_id").orderBy("line_idx").rowsBetween(W.unboundedPreceding, -1)
    latest = [
        F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, F.col("line_idx")), ignorenulls=True).over(before))
        for k in range(1, MAX_LEVEL)
    ]
    return heads.withColumn("parent_line", F.greatest(*latest))


def sections(split: DataFrame) -> DataFrame:
    """(doc_id, line_idx, level, title, own): each heading with the text up to the next one of any level.

    One window and one aggregation; a heading's own line is a member of its group.
    """
    pattern = f"(?d){HEADING}"
    marked = split.withColumn("is_head", F.col("line").rlike(pattern))
    running = W.partitionBy("doc_id").orderBy("line_idx").rowsBetween(W.unboundedPreceding, 0)
    of = F.last(F.when(F.col("is_head"), F.col("line_idx")), ignorenulls=True).over(running)
    below = F.collect_list(F.when(~F.col("is_head"), F.struct("line_idx", "line")))
    grouped = marked.withColumn("of", of).where("of IS NOT NULL").groupBy("doc_id", F.col("of").alias("line_idx")).agg(
        F.max(F.when(F.col("is_head"), F.col("line"))).alias("head"),
        F.array_join(F.transform(F.array_sort(below), lambda x: x["line"]), "\n").alias("own"),
    )
    return grouped.select(
        "doc_id",
        "line_idx",
        F.length(F.regexp_extract("head", pattern, 1)).alias("level"),
        strip(F.regexp_extract("head", pattern, 2)).alias("title"),
        "own",
    )


PIN = r"(?ms)^```pin[ \t]*$\n(.*?)^```[ \t]*$\n?"


def passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, node_id, title, excerpt): the text under each heading, headings counted from 1; blank ones go.

    A document of which nothing is left is one passage, "whole", titled by its id. A null text has none.
    """
    own = sections(lines(docs, text))
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("line_idx"))
    cut = own.select("doc_id", F.concat(F.lit("section-"), nth).alias("node_id"), "title", strip("own").alias("excerpt")).where("excerpt != ''")
    rest = docs.where(F.col(text).isNotNull()).join(cut.select("doc_id").distinct(), "doc_id", "left_anti")
    whole = rest.select("doc_id", F.lit("whole").alias("node_id"), F.col("doc_id").cast("string").alias("title"), strip(text).alias("excerpt"))
    return cut.unionByName(whole)


def strip_pins(text: Column) -> Column:
    """Without pin fences and lone image lines; three line breaks or more become two."""
    t = F.regexp_replace(text, PIN, "")
    t = F.regexp_replace(t, r"(?m)^!\[[^\]]*\]\([^)]*\)[ \t]*$", "")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def pin_body(own: Column) -> Column:
    """The body of the pin fence that opens a heading's text, null if other text comes first."""
    opening = r"(?s)^(?:[ \t]*(?:```(?!pin[ \t]*(?:\n|$))[^\n]*)?\n)*[ \t]*```pin[ \t]*\n(.*?)(?:\n?[ \t]*```[ \t]*(?:\n.*)?$|$)"
    return F.nullif(F.regexp_extract(own, opening, 1), F.lit(""))


def pin_map(body: Column) -> Column:
    """key: value lines of a pin as a map of strings; the last of a key wins."""
    entries = F.transform(
        F.filter(F.split(body, "\n"), lambda x: F.contains(x, F.lit(":"))),
        lambda x: F.struct(
            strip(F.regexp_extract(x, r"^([^:]*):(.*)$", 1)).alias("key"),
            strip(F.regexp_extract(x, r"^([^:]*):(.*)$", 2)).alias("value"),
        ),
    )
    last = F.filter(
        entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"])
    )
    return F.map_from_entries(last)


def pin_values(body: Column) -> Column:
    """The pin's map with typed values: text as it stands, whole and number where it reads as one, list and rows for JSON arrays."""

    def typed(_: Column, v: Column) -> Column:
        flat = F.when(v.startswith("["), F.from_json(v, "array<double>"))
        rows = F.when(v.startswith("[["), F.from_json(v, "array<array<double>>"))
        whole = F.when(v.rlike("^[+-]?[0-9]+$"), v.try_cast("bigint"))
        number = F.when(v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), v.try_cast("double"))
        flat = F.when(rows.isNull(), flat)
        return F.struct(v.alias("text"), whole.alias("whole"), number.alias("number"), flat.alias("list"), rows.alias("rows"))

    return F.transform_values(pin_map(body), typed)


def nodes(docs: DataFrame, text: str = "text") -> DataFrame:
    """The tree of each document.

    (doc_id, node_seq, node_id, parent_seq, title, heading_level, line_idx, is_leaf,
    synthetic, parent_title, content, pin). node_seq is preorder from 0. An internal node with
    text of its own gets a first child "<id>-overview" that holds it. Text before the
    first heading is dropped; a document without headings has no nodes. Content is without
    pins and images; internal nodes have none.
    """
    in_doc = W.partitionBy("doc_id").orderBy("line_idx")
    heads = with_node_ids(sections(lines(docs, text)))
    inner = F.coalesce(F.lead("level").over(in_doc) > F.col("level"), F.lit(False))
    full = (
        heads.withColumn("inner", inner)
        .withColumn("pin", pin_map(pin_body(F.col("own"))))
        .withColumn("own", strip_pins(F.col("own")))
    )
    real = F.struct(
        F.lit(0).alias("part"), "node_id", "title", F.col("level").alias("heading_level"), (~F.col("inner")).alias("is_leaf"),
        F.lit(False).alias("synthetic"), F.lit(None).cast("string").alias("parent_title"),
        F.when(~F.col("inner"), F.col("own")).alias("content"),
    )
    overview = F.struct(
        F.lit(1).alias("part"), F.concat("node_id", F.lit("-overview")).alias("node_id"),
        F.concat("title", F.lit(" — Overview")).alias("title"), (F.col("level") + 1).alias("heading_level"),
        F.lit(True).alias("is_leaf"), F.lit(True).alias("synthetic"), F.col("title").alias("parent_title"), F.col("own").alias("content"),
    )
    both = F.when(F.col("inner") & (F.col("own") != ""), F.array(real, overview)).otherwise(F.array(real))
    rows = full.select("doc_id", "line_idx", "pin", F.explode(both).alias("x")).select("doc_id", "line_idx", "pin", "x.*")
    # preorder is (line, part); the parent is the last heading before with a lower level
    numbered = rows.withColumn("node_seq", F.row_number().over(W.partitionBy("doc_id").orderBy("line_idx", "part")) - 1)
    before = W.partitionBy("doc_id").orderBy("line_idx", "part").rowsBetween(W.unboundedPreceding, -1)
    latest = [
        F.when(
            F.col("heading_level") > k,
            F.last(F.when((F.col("heading_level") == k) & (F.col("part") == 0), F.col("node_seq")), ignorenulls=True).over(before),
        )
        for k in range(1, MAX_LEVEL + 1)
    ]
    return numbered.withColumn("parent_seq", F.greatest(*latest)).select(
        "doc_id", "node_seq", "node_id", "parent_seq", "title", "heading_level", "line_idx", "is_leaf", "synthetic",
        "parent_title", "content", "pin",
    )


def with_ancestors(tree: DataFrame) -> DataFrame:
    """tree with depth (0 at the top), ancestors (node_seq, nearest first) and breadcrumb (titles from the top).

    Of each level, the last heading before a node is its ancestor if no heading of a lower
    level came after it; so all chains are one pass over a document's nodes in order.
    """
    before = W.partitionBy("doc_id").orderBy("node_seq").rowsBetween(W.unboundedPreceding, -1)

    def latest(k: int) -> Column:
        here = (F.col("heading_level") == k) & ~F.col("synthetic")
        return F.last(F.when(here, F.struct("node_seq", "title")), ignorenulls=True).over(before)

    out = tree.select("*", *[latest(k).alias(f"__{k}") for k in range(1, MAX_LEVEL + 1)])
    chain = []
    for k in range(1, MAX_LEVEL + 1):
        lower = [F.coalesce(F.col(f"__{j}.node_seq"), F.lit(-1)) for j in range(1, k)]
        newer = F.greatest(F.lit(-1), F.lit(-1), *lower)
        chain.append(F.when((F.col("heading_level") > k) & (F.col(f"__{k}.node_seq") > newer), F.col(f"__{k}")))
    out = out.withColumn("__chain", F.array_compact(F.array(*chain)))
    crumbs = F.concat(F.transform("__chain", lambda a: a["title"]), F.array("title"))
    return (
        out.withColumn("ancestors", F.reverse(F.transform("__chain", lambda a: a["node_seq"])))
        .withColumn("breadcrumb", F.array_join(crumbs, " > "))
        .withColumn("depth", F.size("__chain"))
        .drop("__chain", *[f"__{k}" for k in range(1, MAX_LEVEL + 1)])
    )


def leaves(tree: DataFrame) -> DataFrame:
    """Leaves with their order in the corpus: documents by id, then tree order.

    The order is a rank within the document plus the leaves of the documents before.
    """
    own = tree.where("is_leaf").withColumn("nth", F.row_number().over(W.partitionBy("doc_id").orderBy("node_seq")) - 1)
    counts = own.groupBy("doc_id").agg(F.count("*").alias("n"))
    earlier = before(counts, [], [F.col("doc_id")], F.col("n"), "before").drop("n")
    return own.join(earlier, "doc_id").withColumn("order", F.col("before") + F.col("nth")).drop("before", "nth")


def leaf_counts(tree: DataFrame) -> DataFrame:
    return tree.groupBy("doc_id").agg(F.count_if("is_leaf").alias("n_leaves"), F.count("*").alias("n_nodes"))


def outline(tree: DataFrame) -> DataFrame:
    """(doc_id, node_seq, outline): descendants as indented bullets, in tree order."""
    below = tree.select("doc_id", "title", "depth", "is_leaf", F.col("node_seq").alias("of"), F.explode("ancestors").alias("node_seq"))
    top = tree.select("doc_id", "node_seq", F.col("depth").alias("top"))
    bullet = F.concat(
        F.repeat(F.lit("  "), F.col("depth") - F.col("top") - 1), F.when(F.col("is_leaf"), F.lit("• ")).otherwise(F.lit("- ")), "title"
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("of", bullet.alias("b")))), lambda x: x["b"])
    return below.join(top, ["doc_id", "node_seq"]).groupBy("doc_id", "node_seq").agg(F.array_join(listed, "\n").alias("outline"))


def heuristic_summaries(tree: DataFrame) -> DataFrame:
    """(doc_id, node_seq, summary): a leaf's first 25 words, a section's first four titles."""
    children = (
        tree.where("parent_seq IS NOT NULL AND NOT synthetic")
        .groupBy("doc_id", F.col("parent_seq").alias("node_seq"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("node_seq", "title"))), lambda x: x["title"]).alias("titles"))
    )
    words = F.filter(F.split(F.coalesce("content", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    leaf = F.concat(F.array_join(F.slice(words, 1, 25), " "), F.when(F.size(words) > 25, F.lit("...")).otherwise(F.lit("")))
    more = F.when(F.size("titles") > 4, F.concat(F.lit(", and "), F.size("titles") - 4, F.lit(" more"))).otherwise(F.lit(""))
    section = F.when(
        F.size("titles") > 0, F.concat(F.lit("Covers: "), F.array_join(F.slice("titles", 1, 4), ", "), more)
    ).otherwise(F.lit("Covers: (no subsections)"))
    return tree.join(children, ["doc_id", "node_seq"], "left").select(
        "doc_id", "node_seq", F.when(F.col("is_leaf"), leaf).otherwise(section).alias("summary")
    )


def gold_leaves(tree: DataFrame, gold: DataFrame) -> DataFrame:
    """gold (doc_id, node_id) with target_leaf: the leaf itself, a section's overview, or null."""
    overview = tree.where("synthetic").select("doc_id", F.col("parent_seq").alias("node_seq"), F.col("node_id").alias("overview"))
    known = tree.join(overview, ["doc_id", "node_seq"], "left").select(
        "doc_id", "node_id", F.when(F.col("is_leaf"), F.col("node_id")).otherwise(F.col("overview")).alias("target_leaf")
    )
    return gold.join(known, ["doc_id", "node_id"], "left")


def ancestor_closure(tree: DataFrame, kept: DataFrame) -> DataFrame:
    """Keys (doc_id, node_seq) of kept leaves and all their ancestors; tree has ancestors."""
    own = tree.join(kept.select("doc_id", "node_seq"), ["doc_id", "node_seq"], "left_semi")
    up = own.select("doc_id", F.explode("ancestors").alias("node_seq"))
    return own.select("doc_id", "node_seq").unionByName(up).distinct()


def kept_within(tree: DataFrame, keep: DataFrame) -> DataFrame:
    """tree (with ancestors) without nodes that keep (doc_id, node_seq) lacks or that lie below such a node."""
    chosen = keep.select("doc_id", "node_seq").distinct()
    gone = tree.select("doc_id", "node_seq").join(chosen, ["doc_id", "node_seq"], "left_anti")
    above = tree.select("doc_id", F.col("node_seq").alias("of"), F.explode("ancestors").alias("node_seq"))
    below = above.join(gone, ["doc_id", "node_seq"], "left_semi").select("doc_id", F.col("of").alias("node_seq"))
    return tree.join(gone.unionByName(below).distinct(), ["doc_id", "node_seq"], "left_anti")


def nested_json(tree: DataFrame, depth: str | None = None) -> DataFrame:
    """(doc_id, tree): each document's nodes as one nested JSON text, for export.

    In preorder each node opens, and closes itself and as many above it as the next node's depth says; so the text is the nodes' own
    texts in order. Depth is that column, or found from the tree's levels. The tree may be pruned, as long as no node has lost the one above.
    """
    leveled = tree.withColumn("__depth", F.col(depth)) if depth else with_ancestors(tree).withColumn("__depth", F.col("depth"))
    fields = [F.col("node_id").alias("nodeId"), "title", F.col("heading_level").alias("headingLevel")]
    own = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    opened = F.concat(F.substr(own, F.lit(1), F.length(own) - 1), F.lit(',"children":['))
    following = F.lead("__depth").over(W.partitionBy("doc_id").orderBy("node_seq"))
    closed = F.repeat(F.lit("]}"), F.col("__depth") - F.coalesce(following, F.lit(0)) + 1)
    text = F.concat(opened, closed, F.when((following <= F.col("__depth")), ",").otherwise(""))
    parts = leveled.select("doc_id", F.struct("node_seq", text.alias("text")).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "")
    return parts.groupBy("doc_id").agg(F.concat(F.lit("["), joined, F.lit("]")).alias("tree"))


def section_texts(tree: DataFrame, limit: int = 4000) -> DataFrame:
    """(doc_id, node_seq, text): what a node has to say, cut to ``limit`` characters; tree has ancestors.

    A node's own content, or else its leaves' titles and contents in order, a blank line between them (a leaf without content: its title);
    "(no content)" if there is none. Lengths are summed along the leaves of each section first, and only the part of a leaf's text that lies within
    the limit is carried to the section, so that no section's whole text is ever gathered.
    """
    piece = F.concat("title", F.lit("\n"), F.coalesce("content", F.lit("")))
    filled = F.length(F.regexp_replace("piece", f"{WHITE}+$", ""))  # the piece without white space at its end, nothing if it is blank
    blank = F.length("piece") - F.length(F.regexp_replace("piece", f"^{WHITE}+", ""))
    leaf = tree.where("is_leaf").withColumn("piece", piece).withColumn("filled", filled).withColumn("blank", blank)
    pairs = leaf.select("doc_id", F.col("node_seq").alias("leaf"), "piece", "filled", "blank", F.explode(F.concat(F.array("node_seq"), "ancestors")).alias("node_seq"))
    section = W.partitionBy("doc_id", "node_seq")
    start = F.coalesce(F.sum(F.length("piece") + 2).over(section.orderBy("leaf").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    some = F.col("filled") > 0
    # the joined text reads from low to high: without white space at its ends, then cut
    low, high = F.min(F.when(some, F.col("start") + F.col("blank"))).over(section), F.max(F.when(some, F.col("start") + F.col("filled"))).over(section)
    placed = pairs.withColumn("start", start).withColumn("low", low).withColumn("high", F.least(high, F.col("low") + limit))
    first, last = F.greatest("start", "low"), F.least(F.col("start") + F.length("piece") + 2, F.col("high"))
    part = F.substr(F.concat("piece", F.lit("\n\n")), (first - F.col("start") + 1).cast("int"), (last - first).cast("int"))
    cut = placed.where(last > first).select("doc_id", "node_seq", "leaf", part.alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "part"))), lambda p: p["part"]), "")
    below = cut.groupBy("doc_id", "node_seq").agg(joined.alias("below"))
    gathered = F.coalesce("below", F.lit(""))
    own = F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(gathered)
    text = F.substr(F.when(own == "", F.lit("(no content)")).otherwise(own), F.lit(1), F.lit(limit))
    return tree.select("doc_id", "node_seq", "content").join(below, ["doc_id", "node_seq"], "left").select("doc_id", "node_seq", text.alias("text"))


NODE_SCHEMA = (
    "node_seq int, parent_seq int, node_id string, title string, heading_level int, line_idx int, is_leaf boolean, synthetic boolean, "
    "parent_title string, content string, summary string"
)


def from_json(files: DataFrame) -> DataFrame:
    """(doc_id, NODE_SCHEMA) of files (doc_id, nodes): nested JSON as nested_json or an index file has it, numbered in preorder.

    Missing fields are null (synthetic: false, summary: ""); null, broken or empty JSON gives no nodes.
    """
    import json

    def flat(text: str | None) -> list[dict]:
        try:
            top = json.loads(text or "[]")
        except ValueError:
            return []
        rows: list[dict] = []
        waiting = [(node, None) for node in reversed(top)] if isinstance(top, list) else []
        while waiting:
            node, parent = waiting.pop()
            below, seq = node.get("children") or [], len(rows)
            row = {"node_seq": seq, "parent_seq": parent, "node_id": node.get("nodeId"), "title": node.get("title")}
            row |= {"heading_level": node.get("headingLevel"), "line_idx": node.get("lineIdx"), "is_leaf": not below}
            row |= {"synthetic": bool(node.get("synthetic")), "parent_title": node.get("parentTitle")}
            rows.append(row | {"content": node.get("content"), "summary": node.get("summary") or ""})
            waiting += [(child, seq) for child in reversed(below)]
        return rows

    @F.arrow_udf(f"array<struct<{NODE_SCHEMA.replace(' ', ':').replace(',:', ', ')}>>")
    def read(texts: pa.Array) -> pa.Array:
        kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
        fields = [(name, kinds[kind]) for name, kind in (f.split() for f in NODE_SCHEMA.split(", "))]
        return pa.array([flat(t) for t in texts.to_pylist()], pa.list_(pa.struct(fields)))

    return files.select("doc_id", F.explode(read(F.col("nodes"))).alias("n")).select("doc_id", "n.*")


# ---- HTML pages as heading documents --------------------------------------------------------


def page_markdown(html: Column, bold: int | None = None) -> Column:
    """Headings and paragraphs of a page as markdown lines; scripts, styles, navigation and comments go.

    With ``bold``, a line that is set in bold as a whole, up to the first tag, is a heading of that level.
    """
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|footer)\b.*?</\1>", "")
    if bold:
        t = F.regexp_replace(t, r"(?is)<p\b[^>]*>[ \t\n]*<b>([^<]*)(?:</b>)?[ \t\n]*(?:<br[^>]*>|</p>)", "\n" + "#" * bold + " $1\n")
    for level in range(1, MAX_LEVEL + 1):
        t = F.regexp_replace(t, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", "\n" + "#" * level + " $1\n")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|p|li|/li|div|/div|article|/article|/title)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    t = F.replace(F.replace(F.replace(t, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]*\n[ \t]*", "\n"), "\n{3,}", "\n\n"))
