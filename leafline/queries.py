"""Registered queries of the library over the star schema and text tables, with DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafline.functions import parsing, text
from leafline.operators import budget, evaluate, facets, index, layout, manifest, matching, prune, rank, tree
from leafline.plans import retrieve as plans
from leafline.streaming import runlog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Questions that the ranking queries ask.
ASKED = [(1, "thing onth ered the ering"), (2, "tion eres nd thing thing"), (3, "und der einer keit"), (4, "eau que les ment")]
STOP_SQL = "[" + ", ".join(f"'{s}'" for s in text.STOPWORDS) + "]"


def terms_sql(column: str) -> str:
    """DuckDB expression of the ranking terms of a column."""
    return (
        f"list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9]+'), "
        f"lambda t: length(t) > 1 AND NOT list_contains({STOP_SQL}, t))"
    )


def content_sql(column: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9]+'), lambda t: length(t) > 2))"


ASKED_SQL = " UNION ALL ".join(f"SELECT {i}::INTEGER AS query_id, '{q}' AS query" for i, q in ASKED)
EST_SQL = "CASE WHEN length({0}) = 0 THEN 0 ELSE floor(length({0}) / 3.4::DOUBLE)::BIGINT + 1 END"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its DuckDB SQL if there is any."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, query string")


def as_leaves(docs: DataFrame) -> DataFrame:
    """Documents as flat leaves: title is the first line, content the whole text."""
    return docs.select("doc_id", F.get(F.split("text", "\n"), 0).alias("title"), F.col("text").alias("content"), "lang", "source")


LEAF_SQL = "SELECT doc_id, string_split(text, chr(10))[1] AS title, text AS content, lang, source FROM documents"

# ---- scalar functions -----------------------------------------------------------------------


@query(f"SELECT doc_id, len({terms_sql('text')})::BIGINT AS n_terms, len(list_distinct({terms_sql('text')}))::BIGINT AS n_distinct FROM documents")
def tokenize_terms(spark, sf_dir):
    terms = text.tokenize("text")
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.size(terms).cast("long").alias("n_terms"), F.size(F.array_distinct(terms)).cast("long").alias("n_distinct")
    )


@query(f"SELECT doc_id, {EST_SQL.format('text')} AS tokens FROM documents")
def est_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens("text").alias("tokens"))


@query(f"SELECT doc_id, sha256(title || chr(10) || content) AS leaf_hash FROM ({LEAF_SQL})")
def leaf_hash(spark, sf_dir):
    return as_leaves(read(spark, sf_dir, "documents")).select("doc_id", text.leaf_hash("title", "content").alias("leaf_hash"))


@query(
    r"""SELECT doc_id, array_to_string(list_slice(w, 1, 25), ' ') || CASE WHEN len(w) > 25 THEN '...' ELSE '' END AS summary
    FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM documents)"""
)
def first25_summary(spark, sf_dir):
    leaves = read(spark, sf_dir, "documents").select(
        "doc_id", F.lit(0).alias("node_seq"), F.lit(None).cast("int").alias("parent_seq"), F.lit("").alias("title"),
        F.col("text").alias("content"), F.lit(True).alias("is_leaf"), F.lit(False).alias("synthetic"),
    )
    return tree.heuristic_summaries(leaves).select("doc_id", "summary")


@query(
    f"""SELECT item_id, count(*) AS n_docs FROM (
      SELECT item_id, n, list_intersect(n, h) AS b
      FROM (SELECT item_id, {content_sql("text")} AS n FROM benchmark)
      CROSS JOIN (SELECT {content_sql("text")} AS h FROM documents))
    WHERE len(n) > 0 AND 2 * len(b) >= len(n) GROUP BY item_id"""
)
def mentions(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", text.content_words("text").alias("h"))
    needles = read(spark, sf_dir, "benchmark").select("item_id", text.content_words("text").alias("n"))
    return matching.mentioned(docs, needles).groupBy("item_id").agg(F.count("*").alias("n_docs"))


_NORM_SQL = r"lower(trim(regexp_replace(translate(coalesce({0}, ''), '“”‘’–—', '""' || repeat(chr(39), 2) || '--'), '[ \t\n\x0B\f\r]+', ' ', 'g')))"


@query(
    f"""SELECT doc_id, item_id FROM (SELECT doc_id, {_NORM_SQL.format("text")} AS body FROM documents)
    JOIN (SELECT item_id, {_NORM_SQL.format("text")} AS quote FROM benchmark) ON contains(body, quote)"""
)
def quote_verbatim(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", text.normalise_quote("text").alias("body"))
    items = read(spark, sf_dir, "benchmark").select("item_id", text.normalise_quote("text").alias("needle"))
    return matching.contained(docs, items)


_RATES = {
    "short": {"input": 2.0, "cache_read": 1.0, "cache_write": 3.0, "output": 6.0},
    "long": {"input": 4.0, "cache_read": 2.0, "cache_write": 5.0, "output": 9.0},
}


def _usage(spark, sf_dir):
    """Line items as usage rows: prices stand for input tokens."""
    whole = F.floor("l_extendedprice").cast("long") * 5
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", whole.alias("total"), F.floor(whole * F.lit(0.5)).cast("long").alias("cached"),
        F.floor(whole * F.lit(0.25)).cast("long").alias("written"), F.floor("l_quantity").cast("long").alias("out"),
        (F.col("l_returnflag") == "R").alias("hit"), F.floor(F.col("l_extendedprice") / 10).cast("long").alias("ms"),
    )


_USAGE_SQL = """SELECT l_orderkey, l_linenumber, t AS total, floor(t * 0.5::DOUBLE)::BIGINT AS cached, floor(t * 0.25::DOUBLE)::BIGINT AS written,
  floor(l_quantity)::BIGINT AS "out", l_returnflag = 'R' AS hit, floor(l_extendedprice / 10)::BIGINT AS ms
  FROM (SELECT *, floor(l_extendedprice)::BIGINT * 5 AS t FROM lineitem)"""
_TIER_SQL = "(greatest(0, total - cached - written) * {input}::DOUBLE + cached * {cache_read}::DOUBLE + written * {cache_write}::DOUBLE + \"out\" * {output}::DOUBLE) / 1e6"
_COST_SQL = f"CASE WHEN total > 272000 THEN {_TIER_SQL.format(**_RATES['long'])} ELSE {_TIER_SQL.format(**_RATES['short'])} END"


def _costed(spark, sf_dir):
    return _usage(spark, sf_dir).withColumn(
        "cost", text.cost_usd(F.col("total"), F.col("cached"), F.col("written"), F.col("out"), _RATES)
    )


@query(
    f"""SELECT l_orderkey, l_linenumber, greatest(0, total - cached - written)::BIGINT AS fresh,
    round({_COST_SQL}, 6) AS cost FROM ({_USAGE_SQL})"""
)
def token_cost(spark, sf_dir):
    fresh = text.fresh_tokens(F.col("total"), F.col("cached"), F.col("written"))
    return _costed(spark, sf_dir).select("l_orderkey", "l_linenumber", fresh.cast("long").alias("fresh"), "cost")


@query(
    f"""SELECT count(*) AS n, sum(total)::BIGINT AS input_tokens, sum("out")::BIGINT AS output_tokens, round(sum(round({_COST_SQL}, 6)), 2) AS cost,
    count(*) FILTER (hit) AS hits, round(avg(hit::INTEGER), 4) AS recall, quantile_disc(ms, 0.5)::DOUBLE AS p50,
    quantile_disc(ms, 0.95)::DOUBLE AS p95, round(avg(ms), 2) AS mean_ms FROM ({_USAGE_SQL})"""
)
def archive_totals(spark, sf_dir):
    return evaluate.totals(_costed(spark, sf_dir).withColumnRenamed("total", "input_tokens").withColumnRenamed("out", "output_tokens"))


# ---- ranking --------------------------------------------------------------------------------


@query(
    f"""WITH t AS (SELECT doc_id, unnest({terms_sql("text")}) AS term FROM documents)
    SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term"""
)
def bm25_stats(spark, sf_dir):
    per = rank.terms(read(spark, sf_dir, "documents"), ["doc_id"], "text")
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def _bm25_sql(items: str, scope: str, k: int, queries: str = ASKED_SQL) -> str:
    """items: SELECT scope, doc_id, text."""
    return f"""
WITH q AS ({queries}), i AS (SELECT *, {terms_sql("text")} AS terms FROM ({items})),
qt AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest({terms_sql("query")}) AS term FROM q) GROUP BY ALL),
stat AS (SELECT {scope} AS scope, count(*) AS n, avg(len(terms)) AS avgdl FROM i GROUP BY 1),
tf AS (SELECT scope, doc_id, dl, term, count(*) AS tf FROM (SELECT {scope} AS scope, doc_id, len(terms) AS dl, unnest(terms) AS term FROM i)
  WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT query_id, scope, doc_id, sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN df USING (scope, term) JOIN stat USING (scope) JOIN qt USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM s WHERE score > 0)
SELECT * FROM r WHERE rank < {k}"""


@query(f"SELECT query_id, doc_id, round(score, 4) AS score, rank::INTEGER AS rank FROM ({_bm25_sql('SELECT doc_id, text FROM documents', '0', 10)})")
def bm25_topk(spark, sf_dir):
    best = rank.top(read(spark, sf_dir, "documents").select("doc_id", "text"), asked(spark), ["doc_id"], "text", 10)
    return best.select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


_DROPPED_SQL = "SELECT source, documents.doc_id, text FROM documents JOIN labels ON labels.doc_id = documents.doc_id AND quality = 0"


@query(
    f"SELECT query_id, scope AS doc_id, doc_id AS node_seq, round(score, 4) AS score, rank::INTEGER AS rank FROM ({_bm25_sql(_DROPPED_SQL, 'source', 5)})"
)
def bm25_rescue(spark, sf_dir):
    low = read(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    dropped = read(spark, sf_dir, "documents").join(low, "doc_id", "left_semi")
    dropped = dropped.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("node_seq"), "text")
    best = rank.rescue(dropped, asked(spark), ["node_seq"], "text")
    return best.select("query_id", "doc_id", "node_seq", F.round("score", 4).alias("score"), "rank")


_ITEMS_SQL = "SELECT item_id AS query_id, text AS query FROM benchmark"


def _benchmark_ranks(spark, sf_dir, k):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rank.top(docs, queries, ["doc_id"], "text", k)


@query(f"SELECT query_id, doc_id, round(score, 3) AS score, rank::INTEGER AS rank FROM ({_bm25_sql('SELECT doc_id, text FROM documents', '0', 5, _ITEMS_SQL)})")
def bm25_benchmark_rank(spark, sf_dir):
    return _benchmark_ranks(spark, sf_dir, 5).select("query_id", "doc_id", F.round("score", 3).alias("score"), "rank")


_RANKS_SQL = f"""WITH top AS ({_bm25_sql('SELECT doc_id, text FROM documents', '0', 50, _ITEMS_SQL)}),
gold AS (SELECT item_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
g AS (SELECT item_id, min(rank) + 1 AS rank FROM gold JOIN top ON query_id = item_id AND top.doc_id = gold.doc_id GROUP BY 1),
x AS (SELECT CASE WHEN b.item_id % 2 = 0 THEN 'A' ELSE 'B' END AS "set", g.rank FROM benchmark b LEFT JOIN g USING (item_id)),
y AS (SELECT "set", rank FROM x UNION ALL SELECT 'all', rank FROM x)"""


@query(
    _RANKS_SQL
    + """ SELECT "set", count(*) AS n, count(*) FILTER (rank IS NULL) AS missing, round(sum(coalesce(1 / rank, 0)) / count(*), 4) AS mrr,
    median(rank) AS median_rank, """
    + ", ".join(f"round(avg(coalesce((rank <= {k})::INTEGER, 0)), 4) AS recall_at_{k}" for k in evaluate.KS)
    + ' FROM y GROUP BY "set"'
)
def recall_at_k(spark, sf_dir):
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    needles = items.select("item_id", F.col("text").alias("needle"))
    gold = matching.contained(docs.select("doc_id", F.col("text").alias("body")), needles)
    top = _benchmark_ranks(spark, sf_dir, 50).withColumnRenamed("query_id", "item_id")
    found = gold.select("item_id", "doc_id").join(top, ["item_id", "doc_id"]).groupBy("item_id").agg((F.min("rank") + 1).alias("rank"))
    named = items.select("item_id", F.when(F.col("item_id") % 2 == 0, "A").otherwise("B").alias("set"))
    return evaluate.rank_summary(named.join(found, "item_id", "left"))


# ---- budgets --------------------------------------------------------------------------------

_COST_LEAF = f"{EST_SQL.format('(title || chr(10) || content)')} + 16"
_CAND_SQL = f"""SELECT l.source, l.doc_id, {_COST_LEAF} AS cost, b.quality = 1 AS relevant,
  row_number() OVER (PARTITION BY l.source ORDER BY l.doc_id) - 1 AS rank
  FROM ({LEAF_SQL}) l LEFT JOIN labels b USING (doc_id)"""
_SCAN_SQL = f"""WITH c AS ({_CAND_SQL}), s AS (SELECT *, sum(CASE WHEN relevant THEN cost ELSE 0 END) OVER (PARTITION BY source ORDER BY rank) AS run, count(*) OVER (PARTITION BY source) AS n FROM c),
u AS (SELECT *, min(CASE WHEN relevant AND run > 20000 THEN rank END) OVER (PARTITION BY source) AS cut FROM s),
v AS (SELECT *, CASE WHEN cut IS NOT NULL AND cut < 400 THEN cut WHEN n >= 400 THEN 400 ELSE n END AS lim FROM u)
SELECT source, doc_id, CASE WHEN rank >= lim THEN 'deferred' WHEN relevant IS NULL THEN 'error' WHEN relevant THEN 'retrieved' ELSE 'rejected' END AS status,
  coalesce(rank = cut AND cut < 400, false) AS judged_relevant FROM v"""


def _scanned(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("relevant"))
    leaves = as_leaves(read(spark, sf_dir, "documents")).join(labels, "doc_id", "left")
    nth = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    cand = leaves.select("source", "doc_id", text.leaf_cost("title", "content").alias("cost"), "relevant", nth.alias("rank"))
    return budget.budget_scan(cand, 20000, by=["source"])


@query(_SCAN_SQL)
def budget_scan(spark, sf_dir):
    return _scanned(spark, sf_dir).select("source", "doc_id", "status", "judged_relevant")


@query(f"SELECT source, status, count(*) AS n FROM ({_SCAN_SQL}) GROUP BY ALL")
def deferred_accounting(spark, sf_dir):
    return _scanned(spark, sf_dir).groupBy("source", "status").agg(F.count("*").alias("n"))


@query(
    f"""SELECT doc_id, coalesce(sum({EST_SQL.format("text")}) OVER (PARTITION BY source ORDER BY doc_id), 0) <= 10000 AS fitted FROM documents"""
)
def budget_fit(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("cost", text.estimate_tokens("text"))
    return budget.budget_fit(docs, 10000, "cost", ["doc_id"], ["source"]).select("doc_id", "fitted")


@query(
    f"""SELECT conv_id, turn, sum({EST_SQL.format("text")}) OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 250 - 40 AS kept FROM conversations"""
)
def context_window(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").withColumn("cost", text.estimate_tokens("text"))
    return budget.context_window(turns, 250, "cost", ["conv_id"], base=40).select("conv_id", "turn", "kept")


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def conversation_roles(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"))


@query("SELECT doc_id, floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 5)::BIGINT AS batch FROM documents")
def child_batches(spark, sf_dir):
    return budget.child_batches(read(spark, sf_dir, "documents"), 5, ["source"], ["doc_id"]).select("doc_id", "batch")


@query(
    f"""WITH RECURSIVE t AS (SELECT conv_id, turn, {EST_SQL.format("text")} + 8 AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    r AS (SELECT conv_id, turn, i, 0::BIGINT AS batch, c::BIGINT AS used, 1::BIGINT AS n FROM t WHERE i = 1
      UNION ALL SELECT t.conv_id, t.turn, t.i, r.batch + CASE WHEN r.used + t.c > 200 OR r.n >= 3 THEN 1 ELSE 0 END,
        CASE WHEN r.used + t.c > 200 OR r.n >= 3 THEN 0 ELSE r.used END + t.c, CASE WHEN r.used + t.c > 200 OR r.n >= 3 THEN 0 ELSE r.n END + 1
      FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
    SELECT conv_id, turn, batch FROM r"""
)
def packed_batches(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").withColumn("cost", text.estimate_tokens("text") + 8)
    return budget.packed_batches(turns, 3, 200, "cost", ["conv_id"], "turn")


@query(
    r"""WITH RECURSIVE s AS (SELECT conv_id, turn, length(text)::DOUBLE AS c, (2 * len(regexp_split_to_array(trim(text), '[ \n]+')))::DOUBLE AS t FROM conversations),
    u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM s WHERE c > 0 AND t > 0),
    r AS (SELECT conv_id, 0::BIGINT AS i, 3.4::DOUBLE AS ratio, 0::DOUBLE AS error FROM u GROUP BY conv_id
      UNION ALL SELECT u.conv_id, u.i, greatest(2::DOUBLE, least(5::DOUBLE, (r.ratio * 0.8::DOUBLE + u.c / u.t * 0.2::DOUBLE) * 0.93::DOUBLE)),
        r.error + abs(greatest(1::DOUBLE, floor(u.c / r.ratio) + 1) - u.t) / u.t FROM r JOIN u ON u.conv_id = r.conv_id AND u.i = r.i + 1)
    SELECT conv_id, round(arg_max(ratio, i), 3) AS ratio, max(i) AS n, round(arg_max(error, i) / max(i), 4) AS mean_abs_error FROM r GROUP BY conv_id"""
)
def token_calibration(spark, sf_dir):
    words = F.size(F.split(F.trim("text"), "[ \n]+"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").alias("chars"), (words * 2).alias("tokens"))
    return budget.calibration(turns, "turn", "chars", "tokens", ["conv_id"])


# ---- tags and facets ------------------------------------------------------------------------

_WANTED = ["fr", "src3"]


def _manifest(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array("lang").alias("tags"), F.array("source").alias("manual_tags"))


@query("SELECT doc_id FROM documents WHERE lang IN ('fr', 'src3') OR source IN ('fr', 'src3')")
def tag_filter_any(spark, sf_dir):
    return manifest.filter_by_tags(_manifest(spark, sf_dir), _WANTED).select("doc_id")


@query("SELECT tag, count(*) AS doc_count FROM (SELECT lang AS tag FROM documents UNION ALL SELECT source FROM documents) GROUP BY tag")
def tag_counts(spark, sf_dir):
    return manifest.tag_counts(_manifest(spark, sf_dir))


_QUESTIONS = {"quality": ["good", "bad"], "tone": ["toxic", "civil"]}


def _facets(spark, sf_dir):
    """Labels as judgements of documents; bad documents were never asked about their tone."""
    labels = read(spark, sf_dir, "labels").withColumn("leaf_hash", F.col("doc_id").cast("string"))
    quality = F.array(F.when(F.col("quality") == 1, "good").otherwise("bad"))
    tone = F.array(F.when(F.col("toxic") == 1, "toxic").otherwise("civil"))
    first = labels.select("leaf_hash", F.lit("quality").alias("question_id"), quality.alias("answer_ids"))
    second = labels.where("quality = 1").select("leaf_hash", F.lit("tone").alias("question_id"), tone.alias("answer_ids"))
    return first.unionByName(second).withColumn("model", F.lit("m")).withColumn("key", F.lit("k"))


def _facet_leaves(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "source", F.col("doc_id").cast("string").alias("leaf_hash"))


@query(
    """SELECT d.doc_id, quality IS NULL AS unjudged FROM documents d LEFT JOIN labels l USING (doc_id)
    WHERE quality IS NULL OR quality = 0 OR toxic = 1"""
)
def facet_any(spark, sf_dir):
    out = facets.select_leaves(_facet_leaves(spark, sf_dir), _facets(spark, sf_dir), ["bad", "toxic"], _QUESTIONS, "any")
    return out.where("kept").select("doc_id", "unjudged")


@query(
    """WITH f AS (SELECT doc_id::VARCHAR AS leaf, 'quality' AS q, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS answer FROM labels
      UNION ALL SELECT doc_id::VARCHAR, 'tone', CASE WHEN toxic = 1 THEN 'toxic' ELSE 'civil' END FROM labels WHERE quality = 1),
    picked AS (SELECT * FROM (VALUES ('quality', 'good'), ('quality', 'bad'), ('tone', 'civil')) p(q, answer)),
    asked AS (SELECT d.doc_id, p.q, count(f.answer) AS stored, count(f.answer) FILTER (f.answer = p.answer) AS fits
      FROM documents d CROSS JOIN picked p LEFT JOIN f ON f.leaf = d.doc_id::VARCHAR AND f.q = p.q GROUP BY ALL)
    SELECT doc_id, sum(stored) = 0 AS unjudged FROM asked GROUP BY doc_id HAVING bool_and(fits > 0 OR stored = 0)"""
)
def facet_all(spark, sf_dir):
    picked = ["good", "bad", "civil"]
    out = facets.select_leaves(_facet_leaves(spark, sf_dir), _facets(spark, sf_dir), picked, _QUESTIONS, "all")
    return out.where("kept").select("doc_id", "unjudged")


@query(
    """SELECT source AS doc_id, CASE WHEN count(quality) = 0 THEN 'missing' WHEN count(quality) >= count(*) THEN 'ready' ELSE 'partial' END AS state,
    count(*) AS leaves, count(quality) AS judged FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"""
)
def facet_coverage(spark, sf_dir):
    leaves = _facet_leaves(spark, sf_dir).select(F.col("source").alias("doc_id"), "leaf_hash")
    return facets.coverage(leaves, _facets(spark, sf_dir), "m", "k")


@query(
    """SELECT d.doc_id::VARCHAR AS leaf_hash, question_id FROM documents d CROSS JOIN (VALUES ('quality'), ('tone')) q(question_id)
    LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NULL OR (question_id = 'tone' AND quality = 0)"""
)
def facet_pending(spark, sf_dir):
    questions = spark.createDataFrame([(q,) for q in _QUESTIONS], "question_id string")
    return facets.pending(_facet_leaves(spark, sf_dir), _facets(spark, sf_dir), questions)


# ---- trees ----------------------------------------------------------------------------------

#: From documents (doc_id, text) to the tree of each, in SQL.
TREE_SQL = r"""l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_idx, unnest(string_split(text, chr(10))) AS line FROM docs),
h AS (SELECT doc_id, line_idx, length(regexp_extract(line, '^(#{1,6})[ \t]', 1)) AS level, trim(regexp_extract(line, '^#+[ \t]+(.*)$', 1), chr(9) || ' ') AS title FROM l WHERE regexp_matches(line, '^#{1,6}[ \t]+.')),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY line_idx) AS nth FROM (SELECT *, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM h)),
p AS (SELECT s.*, slug || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END AS node_id,
  (SELECT max(b.line_idx) FROM h b WHERE b.doc_id = s.doc_id AND b.line_idx < s.line_idx AND b.level < s.level) AS parent_line,
  (SELECT min(b.line_idx) FROM h b WHERE b.doc_id = s.doc_id AND b.line_idx > s.line_idx) AS next_line FROM s),
o AS (SELECT p.*, (SELECT trim(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY l.line_idx), ''), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) FROM l WHERE l.doc_id = p.doc_id AND l.line_idx > p.line_idx AND l.line_idx < coalesce(p.next_line, 1e9)) AS own,
  EXISTS (SELECT 1 FROM p c WHERE c.doc_id = p.doc_id AND c.parent_line = p.line_idx) AS inner_node FROM p),
n AS (SELECT doc_id, line_idx, 0 AS part, node_id, parent_line, title, level AS heading_level, NOT inner_node AS is_leaf, false AS synthetic, CASE WHEN NOT inner_node THEN own END AS content FROM o
  UNION ALL SELECT doc_id, line_idx, 1, node_id || '-overview', line_idx, title || ' — Overview', level + 1, true, true, own FROM o WHERE inner_node AND own != ''),
t AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY line_idx, part) - 1)::INTEGER AS node_seq FROM n),
tree AS (SELECT t.doc_id, t.node_seq, t.node_id, u.node_seq AS parent_seq, t.title, t.heading_level::INTEGER AS heading_level, t.line_idx::INTEGER AS line_idx, t.is_leaf, t.synthetic, t.content
  FROM t LEFT JOIN t u ON u.doc_id = t.doc_id AND u.line_idx = t.parent_line AND u.part = 0)
"""
_OUTLINE_SQL = """
WITH seg AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL),
nat AS (SELECT n_regionkey, n_nationkey, '## ' || n_name || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN 'Nation ' || n_nationkey || chr(10) ELSE '' END
  || string_agg('### ' || c_mktsegment || chr(10) || n || ' customers', chr(10) ORDER BY c_mktsegment) AS body
  FROM nation JOIN seg ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey, n_name),
docs AS (SELECT r_name AS doc_id, '# ' || r_name || chr(10) || 'About ' || r_name || chr(10) || string_agg(body, chr(10) ORDER BY n_nationkey) AS text
  FROM region JOIN nat ON n_regionkey = r_regionkey GROUP BY r_name),
""" + TREE_SQL
#: Each node with the nodes above it.
CHAIN_SQL = """, up AS (SELECT doc_id, node_seq AS of, node_seq, parent_seq, title AS crumb, 0 AS d FROM tree
  UNION ALL SELECT up.doc_id, up.of, tree.node_seq, tree.parent_seq, tree.title || ' > ' || up.crumb, d + 1 FROM up JOIN tree ON tree.doc_id = up.doc_id AND tree.node_seq = up.parent_seq)
"""
_UP_SQL = _OUTLINE_SQL.replace("WITH seg", "WITH RECURSIVE seg") + CHAIN_SQL


def _outlines(spark, sf_dir):
    """A heading document for each region: nations below, market segments below those."""
    seg = read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    line = F.concat(F.lit("### "), "c_mktsegment", F.lit("\n"), "n", F.lit(" customers"))
    listed = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["b"]), "\n")
    intro = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Nation "), "n_nationkey", F.lit("\n"))).otherwise(F.lit(""))
    nations = (
        nation.join(seg, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_regionkey", "n_nationkey", "n_name")
        .agg(listed(F.struct("c_mktsegment", line.alias("b"))).alias("below"))
        .withColumn("body", F.concat(F.lit("## "), "n_name", F.lit("\n"), intro, "below"))
    )
    return (
        region.join(nations, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("doc_id"))
        .agg(listed(F.struct("n_nationkey", F.col("body").alias("b"))).alias("below"))
        .select("doc_id", F.concat(F.lit("# "), "doc_id", F.lit("\nAbout "), "doc_id", F.lit("\n"), "below").alias("text"))
    )


def _tree(spark, sf_dir):
    return tree.nodes(_outlines(spark, sf_dir))


@query(_OUTLINE_SQL + "SELECT doc_id, line_idx::INTEGER AS line_idx, level::INTEGER AS level, title, node_id FROM p")
def heading_parse(spark, sf_dir):
    return tree.headings(tree.lines(_outlines(spark, sf_dir)))


@query(_OUTLINE_SQL + "SELECT slug, count(*) AS n, max(nth)::INTEGER AS most FROM s GROUP BY slug")
def slug_dedup(spark, sf_dir):
    heads = tree.headings(tree.lines(_outlines(spark, sf_dir))).select("doc_id", text.slug("title").alias("slug"))
    per = heads.groupBy("doc_id", "slug").agg(F.count("*").alias("k"))
    return per.groupBy("slug").agg(F.sum("k").alias("n"), F.max("k").cast("int").alias("most"))


@query(_OUTLINE_SQL + "SELECT doc_id, node_seq, node_id, parent_seq, title, heading_level, line_idx, is_leaf, synthetic FROM tree")
def node_tree(spark, sf_dir):
    return _tree(spark, sf_dir).drop("parent_title", "content", "pin")


@query(_OUTLINE_SQL + "SELECT doc_id, node_seq::INTEGER AS node_seq, parent_seq::INTEGER AS parent_seq, node_id, title, heading_level::INTEGER AS heading_level, is_leaf FROM tree")
def index_round_trip(spark, sf_dir):
    written = tree.nested_json(_tree(spark, sf_dir)).withColumnRenamed("tree", "nodes")
    return tree.from_json(written).select("doc_id", "node_seq", "parent_seq", "node_id", "title", "heading_level", "is_leaf")


@query(_OUTLINE_SQL + "SELECT doc_id, node_id, content FROM tree WHERE is_leaf")
def leaf_content(spark, sf_dir):
    return _tree(spark, sf_dir).where("is_leaf").select("doc_id", "node_id", "content")


@query(_OUTLINE_SQL + "SELECT doc_id, node_id, heading_level, content FROM tree WHERE synthetic")
def preamble_promote(spark, sf_dir):
    return _tree(spark, sf_dir).where("synthetic").select("doc_id", "node_id", "heading_level", "content")


@query(_UP_SQL + "SELECT doc_id, of AS node_seq, crumb AS breadcrumb, d::INTEGER AS depth FROM up WHERE parent_seq IS NULL")
def breadcrumbs(spark, sf_dir):
    return tree.with_ancestors(_tree(spark, sf_dir)).select("doc_id", "node_seq", "breadcrumb", "depth")


@query(_UP_SQL + "SELECT DISTINCT doc_id, node_seq FROM up WHERE of IN (SELECT node_seq FROM tree WHERE tree.doc_id = up.doc_id AND is_leaf AND node_seq % 7 = 0)")
def ancestor_closure(spark, sf_dir):
    full = tree.with_ancestors(_tree(spark, sf_dir))
    return tree.ancestor_closure(full, full.where("is_leaf AND node_seq % 7 = 0"))


@query(_UP_SQL + "SELECT DISTINCT doc_id, node_seq FROM up WHERE d > 0 AND of IN (SELECT node_seq FROM tree WHERE tree.doc_id = up.doc_id AND is_leaf AND node_seq % 11 = 0)")
def leads_to_retrieved(spark, sf_dir):
    full = tree.with_ancestors(_tree(spark, sf_dir))
    return prune.leads_to(full, full.where("is_leaf AND node_seq % 11 = 0")).select("doc_id", "node_seq")


@query(
    _UP_SQL
    + """SELECT doc_id, of AS node_seq, bool_and(parent_seq IS NULL OR node_seq % 5 != 3) AS survives FROM up GROUP BY doc_id, of"""
)
def prune_survivors(spark, sf_dir):
    full = tree.with_ancestors(_tree(spark, sf_dir))
    picked = full.where("node_seq % 5 != 3").withColumn("reason", F.lit("picked"))
    out = prune.survivors(full, picked)
    return out.select("doc_id", "node_seq", (F.coalesce("status", F.lit("leaf")) != "pruned").alias("survives"))


@query(
    """SELECT doc_id, i - 1 AS line_idx, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS i FROM documents) WHERE trim(line) != ''"""
)
def paragraph_leaves(spark, sf_dir):
    return tree.lines(read(spark, sf_dir, "documents")).where(F.trim("line") != "")


@query(_OUTLINE_SQL + "SELECT doc_id, count(*) FILTER (is_leaf) AS n_leaves, count(*) AS n_nodes FROM tree GROUP BY doc_id")
def leaf_counts(spark, sf_dir):
    return tree.leaf_counts(_tree(spark, sf_dir))


@query(
    """WITH f AS (SELECT [r_name, n_name] AS parts FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey),
    e AS (SELECT unnest(range(0, 3)) AS depth, parts FROM f)
    SELECT array_to_string(list_slice(parts, 1, depth), '/') AS folder, depth::INTEGER AS depth, count(*) AS docs FROM e GROUP BY ALL"""
)
def folder_rollup(spark, sf_dir):
    files = (
        read(spark, sf_dir, "supplier")
        .join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    )
    return manifest.folder_rollup(files.select(F.concat_ws("/", "r_name", "n_name", F.concat("s_name", F.lit(".md"))).alias("rel_path")))


@query(r"""SELECT page_id, trim(replace(replace(replace(regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title FROM pages""")
def page_headings(spark, sf_dir):
    docs = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), tree.page_markdown(F.col("html")).alias("text"))
    heads = tree.headings(tree.lines(docs)).where("level = 1")
    first = heads.groupBy("doc_id").agg(F.min_by("title", "line_idx").alias("title"))
    return first.select(F.col("doc_id").alias("page_id"), "title")


# ---- incremental index, events --------------------------------------------------------------


@query(
    """SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'added' WHEN doc_id % 10 = 2 THEN 'changed' ELSE 'unchanged' END AS state FROM documents"""
)
def incremental_reuse(spark, sf_dir):
    new = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    old = new.where("doc_id % 10 != 1").withColumn("sha256", F.when(F.col("doc_id") % 10 == 2, F.lit("")).otherwise(F.col("sha256")))
    return index.changed_documents(new, old)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf_dir):
    done = read(spark, sf_dir, "labels").select("doc_id")
    return read(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def last_status(spark, sf_dir):
    return evaluate.last_status(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


_STATE_SQL = "CASE event_type WHEN 'view' THEN 'retrieved' WHEN 'click' THEN 'kept' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'pruned' ELSE 'evaluating' END"


def _states(events):
    return events.withColumn("status", F.expr(_STATE_SQL)).withColumn("run_id", F.to_date("ts"))


@query(
    f"""WITH s AS (SELECT ts::DATE AS run_id, user_id, arg_max({_STATE_SQL}, (ts, event_id)) AS status FROM events GROUP BY ALL)
    SELECT run_id, count(*) AS total, count(*) FILTER (status IN ('kept', 'pruned', 'retrieved', 'rejected', 'deferred', 'error')) AS done,
    """
    + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in runlog.TERMINAL)
    + " FROM s GROUP BY run_id"
)
def run_progress(spark, sf_dir):
    last = runlog.last_statuses(_states(read(spark, sf_dir, "events")), ["run_id", "user_id"], ["ts", "event_id"])
    return runlog.progress(last)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_by_hour(spark, sf_dir):
    return runlog.windowed_counts(read(spark, sf_dir, "events"), "ts", "event_type")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS marks FROM events GROUP BY user_id")
def live_status_stream(spark, sf_dir):
    """The same view from a stream that is drained into the shared store."""
    files = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(files.schema).option("pathGlobFilter", "*.parquet").parquet(_folder_of(sf_dir, "events"))
    view = runlog.last_statuses(stream, ["user_id"], ["ts", "event_id"], "event_type")
    return runlog.run_available(view, "live_status_stream")


def _folder_of(sf_dir, name):
    """A glob that a file stream takes for the one table."""
    return f"{sf_dir}/{name}.parque[t]"


# ---- evaluation -----------------------------------------------------------------------------


@query(
    """SELECT "set", phase, count(ms) AS n, quantile_disc(ms, 0.5)::DOUBLE AS p50, quantile_disc(ms, 0.95)::DOUBLE AS p95 FROM (
      SELECT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS "set", event_type AS phase, value AS ms FROM events
      UNION ALL SELECT 'all', event_type, value FROM events) GROUP BY ALL"""
)
def latency_percentiles(spark, sf_dir):
    timings = read(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("set"), F.col("event_type").alias("phase"), F.col("value").alias("ms")
    )
    return evaluate.latency(timings)


_RECORD_SQL = """SELECT d.doc_id, CASE WHEN d.doc_id % 7 = 0 THEN 'deferred' WHEN quality = 1 THEN 'retrieved' WHEN quality = 0 THEN 'rejected' ELSE 'untouched' END AS gold_outcome,
  coalesce(quality = 1, false) AND d.doc_id % 7 != 0 AS gold_retrieved, coalesce(toxic = 0, false) AND coalesce(quality = 1, false) AS gold_cited,
  CASE WHEN toxic = 1 THEN 'insufficient' WHEN toxic = 0 THEN 'sufficient' ELSE 'missing' END AS label, n_chars % 9 AS n_retrieved,
  d.source AS judgment_raw, n_chars % 40 AS rank FROM documents d LEFT JOIN labels l USING (doc_id)"""


def _records(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    no = F.lit(False)
    good = F.coalesce(F.col("quality") == 1, no)
    seventh = F.col("doc_id") % 7 == 0
    status = F.when(seventh, "deferred").when(F.col("quality") == 1, "retrieved").when(F.col("quality") == 0, "rejected").otherwise("unknown")
    return docs.select(
        "doc_id", evaluate.gold_outcome(status, no, good & ~seventh).alias("gold_outcome"), (good & ~seventh).alias("gold_retrieved"),
        (F.coalesce(F.col("toxic") == 0, no) & good).alias("gold_cited"),
        F.when(F.col("toxic") == 1, "insufficient").when(F.col("toxic") == 0, "sufficient").otherwise("missing").alias("label"),
        (F.col("n_chars") % 9).alias("n_retrieved"), F.col("source").alias("judgment_raw"), (F.col("n_chars") % 40).alias("rank"),
    )


@query(
    f"""SELECT CASE WHEN gold_outcome = 'deferred' THEN 'deferred' WHEN gold_retrieved THEN 'retrieved' ELSE 'missed' END || '_' ||
    CASE WHEN label IN ('sufficient', 'insufficient') THEN label ELSE 'unlabeled' END AS cell, count(*) AS n FROM ({_RECORD_SQL}) GROUP BY ALL"""
)
def confusion_cells(spark, sf_dir):
    return evaluate.confusion_cells(_records(spark, sf_dir))


@query(
    f"""SELECT count(*) AS n, round(avg(gold_retrieved::INTEGER) FILTER (gold_outcome != 'deferred'), 4) AS retrieval_recall,
    round(avg(gold_cited::INTEGER) FILTER (gold_outcome != 'deferred'), 4) AS answer_recall,
    round(avg(gold_cited::INTEGER) FILTER (gold_retrieved), 4) AS cited_given_retrieved, round(avg(n_retrieved), 4) AS mean_retrieved FROM ({_RECORD_SQL})"""
)
def recall_summary(spark, sf_dir):
    return evaluate.recall_summary(_records(spark, sf_dir))


@query(
    f"""SELECT gold_outcome AS outcome, count(*) AS n, median(rank + 1) AS median, quantile_disc(rank + 1, 0.25)::DOUBLE AS p25,
    quantile_disc(rank + 1, 0.75)::DOUBLE AS p75, count(*) FILTER (rank + 1 <= 5) AS up_to_5, count(*) FILTER (rank + 1 BETWEEN 6 AND 20) AS up_to_20,
    count(*) FILTER (rank + 1 > 20) AS beyond FROM ({_RECORD_SQL}) GROUP BY gold_outcome"""
)
def gold_outcome(spark, sf_dir):
    return evaluate.death_section(_records(spark, sf_dir))


@query(f"SELECT judgment_raw AS raw, count(*) AS n FROM ({_RECORD_SQL}) GROUP BY 1 ORDER BY n DESC, raw LIMIT 15")
def label_hist(spark, sf_dir):
    return evaluate.label_histogram(_records(spark, sf_dir))


@query(f"SELECT greatest(1, round_even(avg(n_retrieved), 0)::BIGINT) AS k FROM ({_RECORD_SQL})")
def budget_matched_k(spark, sf_dir):
    return evaluate.budget_matched_k(_records(spark, sf_dir))


_PAIR_SQL = """SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations"""


@query(
    f"""SELECT a.conv_id::VARCHAR || '-' || a.turn AS pair_id, len(list_intersect(a.w, b.w)) = len(a.w) AND len(a.w) = len(b.w) AS same_set,
    round(CASE WHEN len(a.w) + len(b.w) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END, 6) AS jaccard,
    (len(a.w) - len(list_intersect(a.w, b.w)))::INTEGER AS n_only_a FROM ({_PAIR_SQL}) a JOIN ({_PAIR_SQL}) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0"""
)
def pair_drift(spark, sf_dir):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    even = F.col("turn") % 2 == 0
    key = F.concat_ws("-", "conv_id", F.col("turn") - F.col("turn") % 2)  # a turn and the odd one after it
    records = read(spark, sf_dir, "conversations").select(
        F.when(even, key).alias("id"), F.when(even, "A").otherwise("B").alias("set"), F.when(~even, key).alias("pair_id"),
        words.alias("retrieved"), F.lit(True).alias("gold_retrieved"), F.col("role").alias("label"),
    )
    drift = evaluate.pair_drift(records)
    return drift.select("pair_id", "same_set", F.round("jaccard", 6).alias("jaccard"), F.size("only_a").alias("n_only_a"))


_DERANGE_SQL = """WITH q AS (SELECT item_id AS id, item_id % 5 AS gold, [item_id % 3, item_id % 5, item_id % 2] AS retrieved, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS m FROM benchmark),
p AS (SELECT a.id, b.id AS donor, (b.i - a.i + a.m) % a.m AS step, list_contains(b.retrieved, a.gold) AS spoiled FROM q a JOIN q b ON a.i != b.i)
SELECT id, arg_min(donor, (spoiled, step)) AS donor FROM p GROUP BY id"""


@query(_DERANGE_SQL)
def derange(spark, sf_dir):
    item = F.col("item_id")
    rows = read(spark, sf_dir, "benchmark").select(
        item.alias("id"), item.alias("pos"), (item % 5).alias("gold"), F.array(item % 3, item % 5, item % 2).alias("retrieved")
    )
    return evaluate.derange(rows)


@query(
    """SELECT d.source AS doc_id, count(*) AS expected, count(*) FILTER (l.quality IS NULL OR l.quality = 0) AS missing
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source"""
)
def expected_missing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("node_id"))
    good = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("node_id"))
    return evaluate.expected_missing(docs, docs.join(good, "node_id", "left_semi"))


@query(
    """SELECT lang || quality AS label, bool_or(toxic = 0) AS hit, CASE WHEN bool_or(toxic = 0 AND doc_id % 2 = 0) THEN 'walk' WHEN bool_or(toxic = 0) THEN 'rehydrated' END AS how
    FROM documents JOIN labels USING (doc_id) GROUP BY 1"""
)
def golden_recall(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select(
        F.concat("lang", "quality").alias("label"), (F.col("toxic") == 0).alias("retrieved"), (F.col("doc_id") % 2 == 1).alias("rehydrated")
    )
    return evaluate.golden_recall(rows)


_ORDER_SQL = ", ".join(f"'{s}'" for s in prune.DISPLAY_ORDER)


@query(
    f"""WITH s AS (SELECT user_id AS node_seq, {_STATE_SQL} AS status, list_position([{_ORDER_SQL}], {_STATE_SQL}) AS p FROM events)
    SELECT 0 AS doc_id, node_seq, arg_min(status, p) AS status FROM s WHERE p IS NOT NULL GROUP BY node_seq"""
)
def display_status(spark, sf_dir):
    states = _states(read(spark, sf_dir, "events")).select(F.lit(0).alias("doc_id"), F.col("user_id").alias("node_seq"), "status")
    return prune.display_status(states)


@query(
    """WITH q AS (SELECT o_orderkey % 997 AS id, CASE WHEN o_orderstatus = 'P' THEN 'C' WHEN o_orderstatus = 'O' THEN 'A' ELSE 'B' END AS "set" FROM orders)
    SELECT 'duplicate id' AS rule, 'error' AS severity, id::VARCHAR AS id FROM q GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'unknown set', 'error', id::VARCHAR FROM q WHERE "set" = 'C'
    UNION ALL SELECT 'no edit term', 'warning', id::VARCHAR FROM q WHERE "set" = 'B'
    UNION ALL SELECT 'pair is no A row', 'error', id::VARCHAR FROM q WHERE "set" = 'B'"""
)
def validate_queries(spark, sf_dir):
    status = F.col("o_orderstatus")
    rows = read(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 997).cast("string").alias("id"), F.when(status == "P", "C").when(status == "O", "A").otherwise("B").alias("set"),
        F.lit("none").alias("pair_id"), F.lit("d").alias("doc"), F.lit("n").alias("node_id"), F.lit("why").alias("question"), F.lit("").alias("edit_term"),
    )
    leaves = spark.createDataFrame([("d", "n")], "doc string, node_id string")
    return evaluate.validate_queries(rows, leaves)


@query(
    rf"""WITH parts AS (SELECT doc_id, string_split(regexp_replace(text, '([.;:])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
    split AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS no FROM parts),
    found AS (SELECT doc_id, no, list_distinct(regexp_extract_all(sentence, '[0-9]+(?:[.][0-9]+)?')) AS nums, regexp_matches(sentence, '[0-9]') AS digit,
      list_distinct(list_filter(regexp_extract_all(lower(sentence), '[a-z]{{3,}}'), lambda w: NOT list_contains({STOP_SQL}, w))) AS words FROM split),
    asked AS (SELECT item_id, list_distinct(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)?')) AS nums,
      list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda w: NOT list_contains({STOP_SQL}, w))) AS words FROM benchmark),
    scored AS (SELECT item_id, doc_id, no, 4 * len(list_intersect(f.nums, a.nums)) + len(list_intersect(f.words, a.words)) + CASE WHEN digit THEN 2 ELSE 0 END AS score FROM found f CROSS JOIN asked a),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, no) AS nth FROM scored WHERE score > 0)
    SELECT item_id AS answer_id, doc_id, no::INTEGER AS sentence_no, score::INTEGER AS score FROM r WHERE nth <= 3"""
)
def best_sentence(spark, sf_dir):
    answers = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), F.col("text").alias("answer"))
    chunks = read(spark, sf_dir, "documents").select("doc_id", "text")
    return evaluate.best_sentences(chunks, answers, 3)


# ---- layout ---------------------------------------------------------------------------------


def _regions(spark, sf_dir):
    """Line items as regions: order keys are documents, lines regions, quantities tops."""
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("doc_id"), (F.col("l_suppkey") % 3).cast("int").alias("page"), F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("y0"), F.col("l_tax").alias("x0"), (F.col("l_tax") + 1).alias("x1"),
        (F.col("l_quantity") + 1).alias("y1"), F.when(F.col("l_returnflag") == "A", F.col("l_linenumber").cast("double")).alias("order"),
    )


_REGION_SQL = """SELECT l_orderkey % 500 AS doc_id, (l_suppkey % 3)::INTEGER AS page, l_orderkey AS k, l_linenumber AS n, l_quantity AS y0, l_tax AS x0, l_tax + 1 AS x1,
  l_quantity + 1 AS y1, CASE WHEN l_returnflag = 'A' THEN l_linenumber::DOUBLE END AS "order" FROM lineitem"""


@query(
    f"""SELECT doc_id, page, k, n, coalesce("order", coalesce(max("order") OVER (PARTITION BY doc_id, page ORDER BY y0 RANGE UNBOUNDED PRECEDING), 0) + 0.5) AS "order" FROM ({_REGION_SQL})"""
)
def missing_order(spark, sf_dir):
    return layout.infer_order(_regions(spark, sf_dir)).select("doc_id", "page", "k", "n", "order")


@query(f"SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({_REGION_SQL}) GROUP BY ALL")
def union_boxes(spark, sf_dir):
    return layout.union_boxes(_regions(spark, sf_dir), ["doc_id", "page"])


# ---- whole plans ----------------------------------------------------------------------------


def _leaf_tree(docs: DataFrame) -> DataFrame:
    """Documents as lone leaves of a tree each."""
    return docs.select(
        "doc_id", F.lit(0).alias("node_seq"), F.col("doc_id").cast("string").alias("node_id"), F.get(F.split("text", "\n"), 0).alias("title"),
        F.lit("").alias("summary"), F.col("text").alias("content"), F.lit(True).alias("is_leaf"), F.lit(0).alias("depth"),
        F.array().cast("array<int>").alias("ancestors"),
    )


_FLAGSHIP_SQL = f"""WITH leaf AS ({LEAF_SQL}), top AS ({_bm25_sql("SELECT doc_id, title || chr(10) || chr(10) || content AS text FROM (" + LEAF_SQL + ")", "0", 1 << 60, ASKED_SQL.split(" UNION ALL ")[0])}),
j AS (SELECT l.doc_id, coalesce(top.score, 0) AS score, {_COST_LEAF} AS cost, list_distinct({terms_sql("'" + ASKED[0][1] + "'")}) AS qd,
  {terms_sql("title || chr(10) || content")} AS terms FROM leaf l LEFT JOIN top ON top.doc_id = l.doc_id),
k AS (SELECT doc_id, score, cost, len(qd) AS n, len(list_intersect(qd, list_distinct(terms))) AS both_n FROM j),
r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank, 2 * both_n >= n AS rel FROM k),
s AS (SELECT *, sum(CASE WHEN rel THEN cost ELSE 0 END) OVER (ORDER BY rank) AS run, count(*) OVER () AS n_all FROM r),
u AS (SELECT *, min(CASE WHEN rel AND run > 6000 THEN rank END) OVER () AS cut FROM s),
v AS (SELECT *, CASE WHEN cut IS NOT NULL AND cut < 400 THEN cut WHEN n_all >= 400 THEN 400 ELSE n_all END AS lim FROM u)
SELECT 1 AS query_id, doc_id, 0 AS node_seq, doc_id::VARCHAR AS node_id, CASE WHEN rank >= lim THEN 'deferred' WHEN rel THEN 'retrieved' ELSE 'rejected' END AS status,
  CASE WHEN rank < lim THEN 'shares ' || both_n || ' of ' || n || ' terms' END AS reason, rank::INTEGER AS rank, round(score, 4) AS score, false AS rehydrated,
  coalesce(rank = cut AND cut < 400, false) AS judged_relevant, CASE WHEN rank < lim AND rel THEN row_number() OVER (PARTITION BY rank < lim AND rel ORDER BY doc_id) END::INTEGER AS source_no FROM v"""


@query(_FLAGSHIP_SQL)
def retrieve(spark, sf_dir):
    """The flagship: rank all documents for a question, judge them and admit them under a token budget."""
    leaves = _leaf_tree(read(spark, sf_dir, "documents"))
    return plans.retrieve(leaves, asked(spark).where("query_id = 1"), budget=6000)
