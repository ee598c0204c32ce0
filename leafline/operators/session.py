"""Annotated sessions as markdown: headings, text and assets in reading order, with a pin under each heading.

A section's assets come after its text: icons in one leaf, a lone asset below the section, several below a
common heading. All of it is a table of pieces in order; node ids are those that the tree's own parser gives the pieces' lines, and
a pin is one more piece after its heading.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafline.functions.text import squeeze
from leafline.operators.ingest import ICONS, asset_groups
from leafline.operators.layout import ASSET_TYPES, CAPTION_TYPES, MAX_LEVEL, SCALE
from leafline.operators.tree import headings
from leafline.store import stored

#: Characters of a caption that are its heading.
CAPTION_CHARS = 120
_BOX = ("x0", "y0", "x1", "y1")


def caption_heading(caption: Column) -> Column:
    """A caption as a heading's text: one line, no hash signs, cut to CAPTION_CHARS with a mark."""
    line = F.trim(F.replace(squeeze(F.coalesce(caption, F.lit(""))), F.lit("#"), F.lit("")))
    cut = F.concat(F.rtrim(F.substr(line, F.lit(1), F.lit(CAPTION_CHARS - 1))), F.lit("…"))
    return F.when(F.length(line) > CAPTION_CHARS, cut).otherwise(line)


def _number(x: Column) -> Column:
    return F.bround(x.cast("double"), 1).cast("string")


def _list(parts: list[Column]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))


def classed(regions: DataFrame, assets: DataFrame) -> DataFrame:
    """regions with role (heading, asset, body or null), section (the heading region at or before, -1 before the first) and section_level.

    A region with a level is a heading; one without text goes. A caption beside an asset on its page is that asset's and goes.
    """
    order = W.partitionBy("doc_id").orderBy("region_no")
    known = assets.select("doc_id", "region_no", F.lit(True).alias("is_asset"))
    both = regions.join(known, ["doc_id", "region_no"], "left")
    beside = lambda shift: shift("type").isin(ASSET_TYPES) & (shift("page") == F.col("page"))
    taken = F.coalesce(beside(lambda c: F.lead(c).over(order)), F.lit(False)) | F.coalesce(beside(lambda c: F.lag(c).over(order)), F.lit(False))
    said = F.coalesce("text", F.lit("")) != ""
    role = (
        F.when(F.col("type").isin(CAPTION_TYPES) & taken & F.col("is_asset").isNull(), None)
        .when(F.col("level").isNotNull(), F.when(said, F.lit("heading")))
        .when(F.col("is_asset"), F.lit("asset"))
        .when(said, F.lit("body"))
    )
    running = order.rowsBetween(W.unboundedPreceding, 0)
    last = lambda c: F.last(F.when(F.col("role") == "heading", F.col(c)), ignorenulls=True).over(running)
    marked = both.withColumn("role", role)
    out = marked.withColumn("section", F.coalesce(last("region_no"), F.lit(-1))).withColumn("section_level", F.coalesce(last("level"), F.lit(1)))
    return out.drop("is_asset")


def _boxes(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, boxes): as a pin has them, each page's union of boxes, by page."""
    sides = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    per = rows.groupBy(*by, "page").agg(*sides)
    own = F.struct("page", _list([(F.col("page") + 1).cast("string"), *[_number(F.col(s)) for s in _BOX]]).alias("t"))
    return per.groupBy(*by).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda p: p["t"]), ", "), F.lit("]")).alias("boxes"))


def _pieces(regions: DataFrame, assets: DataFrame, base: Column) -> DataFrame:
    """(doc_id, section, part, a, b, text, fields): the lines of the document in order, and the fields of a pin where one belongs.

    A piece's text holds its lines; the empty line after it counts.
    """
    own = stored(classed(regions, assets))  # every piece reads it
    bbox = _list([_number(F.col(s)) for s in _BOX])
    page = (F.col("page") + 1).cast("string")
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    none = F.lit(None).cast("array<string>")
    zero = F.lit(0)

    def piece(rows: DataFrame, part: int, a: Column, b: Column, text: Column, fields: Column = none) -> DataFrame:
        return rows.select(
            "doc_id", F.col("section").cast("long").alias("section"), F.lit(part).alias("part"), a.cast("long").alias("a"), b.cast("long").alias("b"),
            F.concat(text, F.lit("\n")).alias("text"), fields.alias("fields"),
        )

    def heading(level: Column, title: Column) -> Column:
        return F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), title)

    def section_fields(boxes: Column) -> Column:
        return F.array_compact(F.array(F.lit("kind: section"), field("doc", F.col("doc_id").cast("string")), field("page", page), field("bbox", bbox), F.when(boxes.isNotNull(), field("regions", boxes))))

    body = own.where("role = 'body'")
    heads = own.where("role = 'heading'").join(_boxes(body, ["doc_id", "section"]), ["doc_id", "section"], "left")
    held = own.where("role = 'asset'").select("doc_id", "region_no", "page", *_BOX, "section", F.col("section_level").alias("level"))
    placed = stored(asset_groups(assets.join(held, ["doc_id", "region_no"]).withColumn("n", F.col("region_no"))))
    # a group's heading stands one level above its members, for icons they have none of their own
    image = F.concat(F.lit("!["), "type", F.lit(" "), "number", F.lit("]("), base, F.lit("/"), F.element_at(F.split("image", "/"), -1), F.lit(")"))
    icons, real = placed.where("is_icon"), placed.where("NOT is_icon")
    first = F.row_number().over(W.partitionBy("doc_id", "section").orderBy("region_no"))
    below = F.least(F.col("level") + 1, F.lit(MAX_LEVEL))
    icon_head = icons.withColumn("first", first).where("first = 1").join(_boxes(icons, ["doc_id", "section"]), ["doc_id", "section"])
    on_page = icons.groupBy("doc_id", "section", "page").agg(F.count("*").alias("k"))
    where = F.transform(F.array_sort(F.collect_list(F.struct("page", "k"))), lambda p: F.concat(p["k"], F.lit(" on page "), p["page"] + 1))
    told = on_page.groupBy("doc_id", "section").agg(F.sum("k").alias("n"), F.array_join(where, ", ").alias("where"))
    note = F.concat("n", F.lit(" small graphics of nearly one size ("), "where", F.lit("), without captions: likely icons or parts of one infographic, not described."))
    grouped = real.where("group IS NOT NULL")
    group_head = grouped.withColumn("first", first).where("first = 1").join(_boxes(grouped, ["doc_id", "section"]), ["doc_id", "section"])
    asset_fields = F.array(
        F.lit("kind: asset"), field("doc", F.col("doc_id").cast("string")), field("asset", F.col("asset_id")), field("type", F.col("type")), field("page", page),
        field("bbox", bbox), field("image", F.concat(base, F.lit("/"), F.element_at(F.split("image", "/"), -1))),
    )
    table = F.nullif(F.coalesce("table_markdown", F.lit("")), F.lit(""))
    said = F.concat_ws(" ", F.nullif(F.trim(F.coalesce("caption", F.lit(""))), F.lit("")), F.nullif(F.trim(F.coalesce("description", F.lit(""))), F.lit("")))
    n = F.col("region_no")
    parts = [
        piece(heads, 0, zero, zero, heading(F.col("level"), F.col("text")), section_fields(F.col("boxes"))),
        piece(body, 1, n, zero, F.col("text")),
        piece(icon_head, 2, zero, zero, heading(below, F.lit(ICONS)), section_fields(F.col("boxes"))),
        piece(told, 2, zero, F.lit(1), note),
        piece(icons, 2, n + 1, zero, image),
        piece(group_head, 3, zero, zero, heading(below, F.col("group")), section_fields(F.col("boxes"))),
        piece(real, 4, n, zero, heading(F.col("heading_level"), caption_heading(F.col("caption"))), asset_fields),
        piece(real, 4, n, F.lit(1), F.coalesce(table, image)),
        piece(real.where(said != ""), 4, n, F.lit(2), said),
    ]
    return reduce(DataFrame.unionByName, parts)


def session_markdown(regions: DataFrame, assets: DataFrame, base: str = "/assets", golden: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown) of regions (doc_id, region_no, type, text, page, x0, y0, x1, y1, level) in reading order and their assets.

    assets are (doc_id, region_no, asset_id, type, number, caption, image, description, table_markdown, is_icon), one for each asset
    region that is to be shown. Pages count from 0 and are told from 1. golden (doc_id, node_id, label) adds labels to the pin of the node that they name. Null texts count as empty; a document without
    a piece has no row. A document is one row, so it has to fit into a task.
    """
    pieces = _pieces(regions, assets, F.concat(F.lit(base + "/"), F.col("doc_id").cast("string")))
    order = W.partitionBy("doc_id").orderBy("section", "part", "a", "b")
    split = pieces.withColumn("lines", F.split("text", "\n"))
    split = split.withColumn("line_idx", F.coalesce(F.sum(F.size("lines")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    split = stored(split.select("doc_id", "line_idx", "text", "fields"))  # read three times
    every = split.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"), "line_idx").select("doc_id", (F.col("line_idx") + F.col("i")).alias("line_idx"), "line")
    named = split.where("fields IS NOT NULL").join(headings(every).select("doc_id", "line_idx", "node_id"), ["doc_id", "line_idx"])
    labels = F.lit(None).cast("string")
    if golden is not None:
        of = golden.groupBy("doc_id", "node_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("golden"))
        named, labels = named.join(of, ["doc_id", "node_id"], "left"), F.col("golden")
    ends = F.array_compact(F.array(F.lit(f"scale: {SCALE}"), F.when(labels.isNotNull(), F.concat(F.lit("golden: "), labels)), F.lit("```"), F.lit("")))
    pin = F.concat(F.array(F.lit("```pin"), F.concat(F.lit("id: "), "node_id")), F.col("fields"), ends)
    pins = named.select("doc_id", "line_idx", F.lit(1).alias("k"), F.array_join(pin, "\n").alias("text"))
    both = split.select("doc_id", "line_idx", F.lit(0).alias("k"), "text").unionByName(pins)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "k", "text"))), lambda p: p["text"])
    return both.groupBy("doc_id").agg(F.array_join(listed, "\n").alias("markdown"))
