"""Registered queries over web pages as documents of headings, and over streams, with DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.functions import text
from leafline.operators import evaluate, index, outline, session, tree
from leafline.plans import judge
from leafline.queries import _RECORD_SQL, _STATE_SQL, ASKED, CHAIN_SQL, TREE_SQL, _folder_of, _records, _states, query, read, terms_sql
from leafline.store import drop_at_exit, folder, stored
from leafline.streaming import guard, maintain, runlog, status

# ---- pages as documents: every page's title is a heading, and every line set in bold one below ---------------------

_BLOCK = "(?:br|/p|p|li|/li|div|/div|article|/article|/title)"
_MARKDOWN_SQL = "regexp_replace(html, '<!--.*?-->|<script[^a-z].*?</script>|<style[^a-z].*?</style>|<nav[^a-z].*?</nav>|<footer[^a-z].*?</footer>', '', 'gis')"
_MARKDOWN_SQL = rf"regexp_replace({_MARKDOWN_SQL}, '<p\b[^>]*>[ \t\n]*<b>([^<]*)(?:</b>)?[ \t\n]*(?:<br[^>]*>|</p>)', chr(10) || '## \1' || chr(10), 'gis')"
for _level in range(1, 7):
    _MARKDOWN_SQL = rf"regexp_replace({_MARKDOWN_SQL}, '<h{_level}\b[^>]*>(.*?)</h{_level}>', chr(10) || '{'#' * _level} \1' || chr(10), 'gis')"
_MARKDOWN_SQL = rf"regexp_replace(regexp_replace({_MARKDOWN_SQL}, '<{_BLOCK}\b[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'g')"
_MARKDOWN_SQL = f"replace(replace(replace({_MARKDOWN_SQL}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_MARKDOWN_SQL = rf"trim(regexp_replace(regexp_replace({_MARKDOWN_SQL}, '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))"
PAGES_SQL = f"WITH RECURSIVE docs AS (SELECT page_id AS doc_id, {_MARKDOWN_SQL} AS text FROM pages),\n" + TREE_SQL
PAGES_UP_SQL = PAGES_SQL + CHAIN_SQL


def page_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), tree.page_markdown(F.col("html"), bold=2).alias("text"))


def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.nodes(page_docs(spark, sf_dir))


@query(PAGES_SQL + "SELECT doc_id, text, sha256(text) AS sha256 FROM docs")
def page_texts(spark, sf_dir):
    return page_docs(spark, sf_dir).withColumn("sha256", F.sha2("text", 256))


@query(PAGES_SQL + "SELECT doc_id, line_idx::INTEGER AS line_idx, level::INTEGER AS level, title, node_id FROM p")
def page_heading_parse(spark, sf_dir):
    return tree.headings(tree.lines(page_docs(spark, sf_dir)))


@query(PAGES_SQL + "SELECT doc_id, node_seq, node_id, parent_seq, title, heading_level, line_idx, is_leaf, synthetic, content FROM tree")
def page_nodes(spark, sf_dir):
    return page_tree(spark, sf_dir).drop("parent_title", "pin")


@query(PAGES_UP_SQL + "SELECT doc_id, of AS node_seq, crumb AS breadcrumb, d::INTEGER AS depth FROM up WHERE parent_seq IS NULL")
def page_breadcrumbs(spark, sf_dir):
    return tree.with_ancestors(page_tree(spark, sf_dir)).select("doc_id", "node_seq", "breadcrumb", "depth")


# ---- an index that follows a stream of changes ------------------------------------------------------------------

_WORDS_SQL = r"array_to_string(list_slice(regexp_extract_all({0}, '[^ \t\n\x0B\f\r]+'), 1, 12), ' ')"


def _summaries_sql(deepest: int) -> str:
    """Summaries level by level, the deepest first; levels of pages' trees end at 2."""
    out = ", deep AS (SELECT tree.*, (SELECT max(d) FROM up WHERE up.doc_id = tree.doc_id AND of = tree.node_seq) AS depth FROM tree)"
    for d in range(deepest, -1, -1):
        below = f"s{d + 1}" if d < deepest else "(SELECT *, '' AS summary FROM deep WHERE false)"
        listed = f"SELECT doc_id, parent_seq, string_agg('- ' || CASE WHEN synthetic THEN '(section prose)' ELSE title END || ': ' || summary, chr(10) ORDER BY node_seq) AS b FROM {below} GROUP BY ALL"
        inputs = f"SELECT t.*, t.title || chr(10) || coalesce(CASE WHEN is_leaf THEN content ELSE c.b END, '') AS inp FROM deep t LEFT JOIN ({listed}) c ON c.doc_id = t.doc_id AND c.parent_seq = t.node_seq WHERE depth = {d}"
        out += f", i{d} AS ({inputs}), s{d} AS (SELECT *, {_WORDS_SQL.format('inp')} AS summary FROM i{d})"
    return out


@query(
    PAGES_UP_SQL.replace("FROM pages)", "FROM pages WHERE page_id % 7 != 2)")
    + _summaries_sql(2)
    + " SELECT doc_id, node_seq, node_id, parent_seq, title, is_leaf, depth::INTEGER AS depth, summary, sha256(inp) AS content_hash FROM ("
    + " UNION ALL ".join(f"SELECT * FROM s{d}" for d in range(3))
    + ")"
)
def index_stream(spark, sf_dir):
    """Pages come in two drained rounds: some late, some in an earlier form first, some taken back; the index is as if built once."""
    at = f"{folder(spark)}/leafline-index-{uuid.uuid4().hex}"
    drop_at_exit(spark, at)
    now = stored(page_docs(spark, sf_dir)).select("doc_id", "text", F.lit(False).alias("deleted"))  # pages are parsed once, for both rounds
    shorter = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"\n[^\n]*$", "")).otherwise(F.col("text"))
    first = now.where("doc_id % 5 != 1").withColumn("text", shorter).withColumn("version", F.lit(1))
    outdated = now.where("doc_id % 4 = 0").withColumn("text", F.lit("# old")).withColumn("version", F.lit(0))
    taken_back = (F.col("doc_id") % 7 == 2).alias("deleted")
    second = now.select("doc_id", "text", taken_back, F.lit(2).alias("version")).unionByName(outdated)
    store = maintain.IndexStore(spark, at, buckets=16)
    for change in (first, second):
        change.write.mode("append").parquet(f"{at}/changes")
        stream = spark.readStream.schema(change.schema).parquet(f"{at}/changes")
        maintain.maintain(stream, store, lambda c: text.first_words(c, 12), "first words").awaitTermination()
    return store.read().select("doc_id", "node_seq", "node_id", "parent_seq", "title", "is_leaf", "depth", "summary", "content_hash")


# ---- states of nodes as a stream ------------------------------------------------------------------------------------


@query(
    f"""WITH m AS (SELECT ts::DATE AS run_id, user_id, ts, event_id, {_STATE_SQL} AS status FROM events),
    f AS (SELECT *, status != lag(status) OVER (PARTITION BY run_id, user_id ORDER BY ts, event_id) AS moved FROM m)
    SELECT run_id, user_id, arg_max(status, (ts, event_id)) AS status, count(*) AS marks, count(*) FILTER (moved) AS moves, 0::BIGINT AS refused FROM f GROUP BY run_id, user_id"""
)
def status_machine(spark, sf_dir):
    """Every user's status within a day, from a stream of marks through the keyed state machine."""
    files = spark.read.parquet(f"{sf_dir}/events.parquet")
    marks = _states(spark.readStream.schema(files.schema).option("pathGlobFilter", "*.parquet").parquet(_folder_of(sf_dir, "events")))
    key = ["run_id", "user_id"]
    with status.rocksdb(spark):
        updates = runlog.run_available(status.statuses(marks, key, "ts", "event_id"), "status_machine", "update")
    return status.latest(updates, key).select(*key, "status", "marks", "moves", "refused")


# ---- a log that ends where the corpus changes -----------------------------------------------------------------------


@query(
    """WITH e AS (SELECT event_id, user_id, ts, date_trunc('week', ts)::DATE AS index_fingerprint FROM events),
    f AS (SELECT user_id, arg_min(index_fingerprint, (ts, event_id)) AS expected FROM e GROUP BY user_id),
    c AS (SELECT e.user_id, min((ts, event_id)) AS cut FROM e JOIN f USING (user_id) WHERE index_fingerprint != expected GROUP BY e.user_id)
    SELECT event_id, e.user_id, index_fingerprint, cut IS NOT NULL AS aborted FROM e LEFT JOIN c USING (user_id) WHERE cut IS NULL OR (ts, event_id) <= cut"""
)
def guarded_log(spark, sf_dir):
    """Every user's events as a run's records, made on another index each week: those up to the first one of another week."""
    at = f"{folder(spark)}/leafline-guard-{uuid.uuid4().hex}"
    drop_at_exit(spark, at)
    files = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(files.schema).option("pathGlobFilter", "*.parquet").parquet(_folder_of(sf_dir, "events"))
    records = stream.select("event_id", "user_id", "ts", F.date_trunc("week", "ts").cast("date").alias("index_fingerprint"))
    kept = guard.guarded(records, at, "user_id", ["ts", "event_id"])
    stops = guard.runs(spark, at).select("run", F.col("stop").isNotNull().alias("aborted"))
    return kept.join(stops, kept["user_id"] == stops["run"]).select("event_id", "user_id", "index_fingerprint", "aborted")


# ---- embedded outlines: an order's lines as a document's entries, spoilt in another way for each ninth of the orders --------

_LINES_SQL = """WITH l AS (SELECT l_orderkey AS doc_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))::INTEGER AS r,
  p_name || ' ' || lower(p_type) || ' for ' || l_suppkey AS t, l_orderkey % 9 AS k FROM lineitem JOIN part ON p_partkey = l_partkey),
raw AS (SELECT doc_id, r AS entry_no, CASE WHEN k = 2 AND r % 3 = 1 THEN 'Contents' WHEN k = 3 THEN 'Page ' || r ELSE t END AS title,
  CASE WHEN k = 1 THEN CASE WHEN r = 1 THEN 0 ELSE 1 + r % 2 END WHEN k = 6 THEN 0 ELSE (r - 1) % 3 END AS level, CASE WHEN k = 7 THEN -1 WHEN k = 5 THEN 10 - r ELSE r END AS page FROM l),
titles AS (SELECT doc_id, CASE WHEN r % 2 = 0 THEN regexp_replace(t, '^[a-z]+ ', '') ELSE t END AS title, CASE WHEN k = 8 AND r % 2 = 1 THEN r + 3 WHEN k = 5 THEN 10 - r WHEN r % 7 = 0 THEN -1 ELSE r + 1 END AS p
  FROM l WHERE k != 4 OR r = 1),
c AS (SELECT *, count(*) FILTER (level = 0) OVER (PARTITION BY doc_id) = 1 AND count(*) OVER (PARTITION BY doc_id) > 1 AS lone FROM raw),
u AS (SELECT doc_id, entry_no, title, (level - lone::INTEGER)::INTEGER AS level, page, lone, lower(title) = 'contents' AS service FROM c WHERE NOT (lone AND level = 0)),
w AS (SELECT u.*, list_distinct(list_filter(string_split(lower(title), ' '), lambda x: length(x) > 1)) AS ws FROM u),
v AS (SELECT doc_id, p, lower(title) AS title, list_distinct(list_filter(string_split(lower(title), ' '), lambda x: length(x) > 1)) AS ws FROM titles),
hits AS (SELECT DISTINCT w.doc_id, entry_no FROM w JOIN v ON v.doc_id = w.doc_id WHERE NOT service AND (page < 0 OR p < 0 OR abs(page - p) <= 1)
  AND (lower(w.title) = v.title OR 10 * len(list_intersect(w.ws, v.ws)) >= 7 * least(len(w.ws), len(v.ws)))),
m AS (SELECT u.*, hits.entry_no IS NOT NULL AS hit FROM u LEFT JOIN hits ON hits.doc_id = u.doc_id AND hits.entry_no = u.entry_no),
f AS (SELECT *, hit AND page >= 0 AND coalesce(page < lag(page) OVER (PARTITION BY doc_id, hit AND page >= 0 ORDER BY entry_no), false) AS falls FROM m),
a AS (SELECT doc_id, count(*) FILTER (NOT service) AS n, count(*) FILTER (hit) AS h, count(*) FILTER (NOT service AND title LIKE 'Page %') AS anchors, bool_or(lone) AS lone,
  count(*) FILTER (service) AS s, bool_or(falls) AS falls, count(DISTINCT CASE WHEN hit THEN level END) AS levels FROM f GROUP BY doc_id),
st AS (SELECT o_orderkey AS doc_id, a.* EXCLUDE (doc_id), CASE WHEN n IS NULL THEN 0 WHEN n = 0 THEN 1 WHEN anchors >= greatest(3, n // 2) THEN 2 WHEN 2 * h < n OR h < 2 THEN 3
  WHEN falls THEN 4 WHEN levels = 1 AND h > 3 THEN 5 ELSE 6 END AS stage FROM orders LEFT JOIN a ON a.doc_id = o_orderkey),
verdicts AS (SELECT doc_id, CASE WHEN stage < 5 THEN 'reject' WHEN stage = 5 THEN 'titles_only' ELSE 'full' END AS verdict, coalesce(n, 0) AS n_entries, coalesce(h, 0) AS n_matched,
  CASE WHEN stage > 2 THEN h / n ELSE 0 END::DOUBLE AS match_rate, stage, lone, s FROM st)
"""


def _outline_tables(spark, sf_dir):
    """(docs, entries, titles) as in the SQL."""
    own = F.row_number().over(tree.W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    title = F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" for "), "l_suppkey")
    rows = lines.select(F.col("l_orderkey").alias("doc_id"), own.alias("r"), title.alias("t"), (F.col("l_orderkey") % 9).alias("k"))
    r, k, t = F.col("r"), F.col("k"), F.col("t")
    entries = rows.select(
        "doc_id", r.alias("entry_no"), F.when((k == 2) & (r % 3 == 1), "Contents").when(k == 3, F.concat(F.lit("Page "), r)).otherwise(t).alias("title"),
        F.when((k == 1) & (r == 1), 0).when(k == 1, 1 + r % 2).when(k == 6, 0).otherwise((r - 1) % 3).alias("level"),
        F.when(k == 7, -1).when(k == 5, 10 - r).otherwise(r).alias("page"),
    )
    shorter = F.when(r % 2 == 0, F.regexp_replace(t, "^[a-z]+ ", "")).otherwise(t)
    page = F.when((k == 8) & (r % 2 == 1), r + 3).when(k == 5, 10 - r).when(r % 7 == 0, -1).otherwise(r + 1)
    titles = rows.where((k != 4) | (r == 1)).select("doc_id", shorter.alias("title"), page.alias("page"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")), entries, titles


@query(
    _LINES_SQL
    + """SELECT doc_id, verdict, n_entries, n_matched, round(match_rate, 6) AS match_rate, array_to_string(list_filter([CASE WHEN lone THEN 'unwrapped single root' END, CASE WHEN s > 0 THEN 'pruned ' || s || ' service entries' END,
    CASE WHEN stage > 2 AND n_entries > n_matched THEN 'pruned ' || (n_entries - n_matched) || ' unmatched entries' END,
    ['absent', 'nothing after prune', 'page anchors', 'too few entries match', 'pages go back', 'flat levels', NULL][stage + 1]], lambda x: x IS NOT NULL), '; ') AS notes FROM verdicts"""
)
def outline_verdicts(spark, sf_dir):
    verdicts, _ = outline.gate(*_outline_tables(spark, sf_dir))
    return verdicts.withColumn("match_rate", F.round("match_rate", 6)).withColumn("notes", F.array_join("notes", "; "))


@query(
    _LINES_SQL
    + """, k AS (SELECT m.doc_id, entry_no, title, level FROM m JOIN verdicts USING (doc_id) WHERE hit AND verdict = 'full'),
    p AS (SELECT k.*, (SELECT max(b.entry_no) FROM k b WHERE b.doc_id = k.doc_id AND b.entry_no < k.entry_no AND b.level < k.level) AS parent_no FROM k)
    SELECT p.*, EXISTS (SELECT 1 FROM p c WHERE c.doc_id = p.doc_id AND c.parent_no = p.entry_no) = false AS is_leaf FROM p"""
)
def outline_nodes(spark, sf_dir):
    verdicts, kept = outline.gate(*_outline_tables(spark, sf_dir))
    full = kept.join(verdicts.where("verdict = 'full'").select("doc_id"), "doc_id", "left_semi")
    return outline.outline_tree(full).drop("depth")


# ---- pruned trees as nested texts, and what sections say ----------------------------------------------------------------


def _nested_sql(deepest: int) -> str:
    """Nested JSON level by level, the deepest first."""
    quoted = "'\"' || replace(replace({0}, '\\', '\\\\'), '\"', '\\\"') || '\"'"
    out = ", kept AS (SELECT doc_id, of AS node_seq, max(d) AS depth FROM up GROUP BY doc_id, of HAVING bool_and(node_seq % 3 != 1))"
    out += ", deep AS (SELECT tree.*, depth FROM tree JOIN kept ON kept.doc_id = tree.doc_id AND kept.node_seq = tree.node_seq)"
    for d in range(deepest, -1, -1):
        below = f"j{d + 1}" if d < deepest else "(SELECT *, '' AS j FROM deep WHERE false)"
        listed = f"SELECT doc_id, parent_seq, string_agg(j, ',' ORDER BY node_seq) AS b FROM {below} GROUP BY ALL"
        own = f"'{{\"nodeId\":' || {quoted.format('node_id')} || ',\"title\":' || {quoted.format('title')} || ',\"headingLevel\":' || heading_level || ',\"children\":[' || coalesce(b, '') || ']}}'"
        out += f", j{d} AS (SELECT t.*, {own} AS j FROM deep t LEFT JOIN ({listed}) c ON c.doc_id = t.doc_id AND c.parent_seq = t.node_seq WHERE depth = {d})"
    return out + " SELECT doc_id, '[' || string_agg(j, ',' ORDER BY node_seq) || ']' AS tree FROM j0 GROUP BY doc_id"


@query(PAGES_UP_SQL + _nested_sql(2))
def pruned_json(spark, sf_dir):
    full = tree.with_ancestors(page_tree(spark, sf_dir))
    return tree.nested_json(tree.kept_within(full, full.where("node_seq % 3 != 1")), "depth")


_ASKED_TERMS = terms_sql("'" + ASKED[0][1] + "'")


@query(
    PAGES_UP_SQL
    + f""", b AS (SELECT up.doc_id, up.node_seq, string_agg(t.title || chr(10) || coalesce(t.content, ''), chr(10) || chr(10) ORDER BY t.node_seq) AS below
      FROM up JOIN tree t ON t.doc_id = up.doc_id AND t.node_seq = up.of WHERE t.is_leaf GROUP BY up.doc_id, up.node_seq),
    x AS (SELECT tree.doc_id, tree.node_seq, title, substr(CASE WHEN coalesce(content, '') != '' THEN content ELSE trim(below, ' ' || chr(9) || chr(10)) END, 1, 4000) AS text FROM tree JOIN b ON b.doc_id = tree.doc_id AND b.node_seq = tree.node_seq),
    y AS (SELECT *, list_distinct({_ASKED_TERMS}) AS qd, list_distinct({terms_sql("text")}) AS td FROM x)
    SELECT 1 AS query_id, doc_id, node_seq, title AS topic, 2 * len(list_intersect(qd, td)) >= len(qd) AS addresses_query,
      'shares ' || len(list_intersect(qd, td)) || ' of ' || len(qd) || ' terms' AS reason, length(text) AS n_chars, sha256(text) AS sha256 FROM y"""
)
def explain_sections(spark, sf_dir):
    full = tree.with_ancestors(page_tree(spark, sf_dir))
    asked = full.select(F.lit(1).alias("query_id"), F.lit(ASKED[0][1]).alias("query"), "doc_id", "node_seq")
    told = judge.explained(full, asked, judge.lexical_judge())
    read_ = tree.section_texts(full).select("doc_id", "node_seq", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))
    return told.join(read_, ["doc_id", "node_seq"])


# ---- digests ---------------------------------------------------------------------------------------------------------


def _digests_sql(levels: int, width: int) -> str:
    out = "WITH l0 AS (SELECT row_number() OVER (ORDER BY doc_id::VARCHAR) - 1 AS rank, doc_id::VARCHAR || sha256(text) AS text FROM documents)"
    for k in range(1, levels + 1):
        out += f", l{k} AS (SELECT rank // {width} AS rank, sha256(string_agg(text, '' ORDER BY rank)) AS text FROM l{k - 1} GROUP BY rank // {width})"
    cases = " ".join(f"WHEN (SELECT count(*) FROM l{k}) = 1 THEN (SELECT max(text) FROM l{k})" for k in range(1, levels + 1))
    return out + f" SELECT substr(CASE {cases} END, 1, 32) AS fingerprint"


@query(_digests_sql(4, 64))
def corpus_fingerprint(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("sha256"))
    return index.fingerprint(files, width=64)


@query(
    """SELECT s_suppkey AS id, canonical, 'v' || s_nationkey || '|p3|q' || substr(sha256(canonical), 1, 12) AS key FROM (
    SELECT s_suppkey, s_nationkey, '{"facets":[{"answers":["' || s_name || '","none"],"id":"f' || s_suppkey || '"}],"name":"' || s_name || '","version":' || s_nationkey || '}' AS canonical FROM supplier)"""
)
def question_keys(spark, sf_dir):
    """Question sets with their keys in one order or another, spaced or not."""
    name, key, version = F.col("s_name"), F.col("s_suppkey"), F.col("s_nationkey")
    spaced = F.concat(
        F.lit('{ "version" : '), version, F.lit(',\n "name": "'), name, F.lit('",\t"facets": [ {"id": "f'), key, F.lit('", "answers": ["'), name, F.lit('", "none"]} ] }')
    )
    plain = F.concat(F.lit('{"name":"'), name, F.lit('","facets":[{"answers":["'), name, F.lit('","none"],"id":"f'), key, F.lit('"}],"version":'), version, F.lit("}"))
    json = F.when(key % 2 == 0, spaced).otherwise(plain)
    return read(spark, sf_dir, "supplier").select(
        key.alias("id"), text.canonical_json(json).alias("canonical"), text.judgement_key(json, version.cast("string"), 3).alias("key")
    )


# ---- forced passages, invented terms, baselines ------------------------------------------------------------------------

_HEX = "('0x' || substr(md5(id || '|7|{0}'), 1, 15))::BIGINT"


@query(
    f"""WITH pool AS (SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS rank, {terms_sql("text")} AS terms FROM documents),
    own AS (SELECT source, min(rank) AS low, count(*) AS own FROM pool GROUP BY source),
    q AS (SELECT doc_id AS id, source, low, own, (SELECT count(*) FROM pool) - own AS n,
      list_distinct({terms_sql("array_to_string(list_slice(regexp_extract_all(text, '[^ " + chr(92) + "t" + chr(92) + "n" + chr(92) + "x0B" + chr(92) + "f" + chr(92) + "r]+'), 1, 8), ' ')")}) AS qd FROM documents JOIN own USING (source)),
    d AS (SELECT *, {_HEX.format("start")} % n AS start, 1 + {_HEX.format("stride")} % greatest(1, (n - 1) // 3) AS stride, unnest([0, 1, 2]) AS nth FROM q WHERE n > 0),
    a AS (SELECT *, (start + nth * CASE WHEN n <= 3 THEN 1 ELSE stride END) % n AS place FROM d WHERE nth < n),
    j AS (SELECT a.id, len(qd) > 0 AND 2 * len(list_intersect(qd, list_distinct(terms))) >= len(qd) AS rel FROM a JOIN pool ON pool.rank = place + CASE WHEN place >= low THEN own ELSE 0 END),
    g AS (SELECT id, count(*) AS n_sources, count(*) FILTER (rel) AS n_relevant FROM j GROUP BY id)
    SELECT id, n_sources, n_relevant, CASE WHEN n_relevant = 0 THEN 'insufficient' WHEN n_relevant < n_sources THEN 'partial' ELSE 'sufficient' END AS label, n_relevant = 0 AS passed FROM g"""
)
def forced_pairing(spark, sf_dir):
    """Each document's first words as a question, answered from three documents of other sources."""
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("leaf_id"), "text")
    queries = docs.select(F.col("leaf_id").alias("id"), "doc_id", text.first_words("text", 8).alias("query"))
    drawn = evaluate.decoys(queries, docs, 3, seed=7)
    return evaluate.forced_answers(queries, drawn, docs, judge.lexical_judge())


@query(
    """WITH r AS (SELECT a.conv_id, a.turn, regexp_extract(lower(a.text), '[a-z]{4,}') AS term, a.text AS answer, b.text AS needed FROM conversations a
      LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
    t AS (SELECT conv_id, turn, nullif(term, '') AS term, answer, coalesce(needed, '') AS needed FROM r)
    SELECT count(*) AS n, count(*) FILTER (turn % 2 = 0) AS insufficient, count(*) FILTER (contains(lower(needed), term)) AS in_needed, count(*) FILTER (contains(lower(coalesce(answer, '')), term)) AS in_answer FROM t"""
)
def invented_terms(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("still_needed"))
    term = F.nullif(F.regexp_extract(F.lower("text"), "[a-z]{4,}", 0), F.lit(""))
    label = F.when(F.col("turn") % 2 == 0, "insufficient").otherwise("sufficient")
    records = turns.join(after, ["conv_id", "turn"], "left").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), term.alias("edit_term"), F.col("text").alias("answer"), "still_needed", label.alias("label")
    )
    return evaluate.named_summary(evaluate.named_terms(records))


def _facts_sql(section: str, rows: str, facts: dict[str, str]) -> list[str]:
    return [f"SELECT '{section}' AS section, '{name}' AS fact, ({value})::DOUBLE AS value, count(*) AS n FROM {rows}" for name, value in facts.items()]


@query(
    f"WITH m AS ({_RECORD_SQL}), k AS (SELECT * FROM m WHERE gold_outcome NOT IN ('deferred', 'deferred_judged_relevant')), b AS (SELECT CASE WHEN n_chars % 50 > 0 THEN n_chars % 50 END AS rank FROM documents), "
    "f AS (SELECT coalesce(quality = 1, false) AS gold_cited, n_chars % 5 AS n_cited, CASE WHEN doc_id % 11 = 0 THEN 'MISS' ELSE 'HIT' END AS cache FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 13 != 0), "
    "c AS (SELECT CASE WHEN toxic = 1 THEN 'insufficient' ELSE 'sufficient' END AS label, quality FROM labels) "
    + " UNION ALL ".join(
        _facts_sql("system", "k", {"recall": "avg(gold_retrieved::INTEGER)"})
        + _facts_sql("system", "m", {"budget-matched k": "greatest(1, round_even(avg(n_retrieved), 0))"})
        + _facts_sql("bm25", "b", {f"recall@{k}": f"avg(coalesce(rank <= {k}, false)::INTEGER)" for k in evaluate.KS} | {"mrr": "avg(coalesce(1 / rank, 0))", "median rank": "median(rank)"})
        + _facts_sql("frontier", "f", {"gold cited": "count(*) FILTER (gold_cited)", "mean cited": "avg(n_cited)", "cache misses": "count(*) FILTER (cache = 'MISS')"})
        + _facts_sql("forced", "c", {"said insufficient": "count(*) FILTER (label = 'insufficient')", "grounded": "count(*) FILTER (quality = 1)"})
    )
    + " UNION ALL SELECT 'forced', 'label ' || label, count(*)::DOUBLE, (SELECT count(*) FROM c) FROM c GROUP BY label"
)
def baselines(spark, sf_dir):
    main = _records(spark, sf_dir).withColumn("error", F.lit(None).cast("string"))
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    rank = F.nullif(F.col("n_chars") % 50, F.lit(0))
    frontier = docs.select(
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("gold_cited"), (F.col("n_chars") % 5).alias("n_cited"),
        F.when(F.col("doc_id") % 11 == 0, "MISS").otherwise("HIT").alias("cache"), F.when(F.col("doc_id") % 13 == 0, "timeout").alias("error"),
    )
    label, grounded = F.when(F.col("toxic") == 1, "insufficient").otherwise("sufficient"), F.when(F.col("quality") == 1, "grounded")
    forced = read(spark, sf_dir, "labels").select(label.alias("label"), (F.col("toxic") == 1).alias("passed"), grounded.alias("grounding_status"))
    return evaluate.baselines(main, docs.select(F.lit("A").alias("set"), rank.alias("rank")), frontier, forced)


# ---- sessions as markdown: an order's lines as regions, every third a heading, the next its text, the next a figure --------

_PIN_SQL = "'```pin' || chr(10) || 'id: ' || {0} || chr(10) || 'kind: {1}' || chr(10) || 'doc: ' || doc_id || chr(10) || {2} || 'page: ' || (page + 1) || chr(10) || 'bbox: ' || box || chr(10) || {3} || 'scale: 2.0' || chr(10) || '```' || chr(10)"


@query(
    """WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r, l_partkey AS p FROM lineitem),
    x AS (SELECT doc_id, r, p, r // 4 AS page, (r - 1) // 3 AS section, (r - 1) % 3 AS k, (10 * r)::DOUBLE || ', ' || r::DOUBLE || ', ' || (10 * r + 5.5)::DOUBLE || ', ' || (r + 2)::DOUBLE AS sides, 1 + r % 2 AS level FROM l),
    y AS (SELECT *, '[' || sides || ']' AS box FROM x),
    b AS (SELECT doc_id, section, 'regions: [[' || (page + 1) || ', ' || sides || ']]' || chr(10) AS regions FROM y WHERE k = 1),
    h AS (SELECT y.doc_id, r, """
    + "repeat('#', level::INTEGER) || ' Part ' || r || ' of ' || p || chr(10) || chr(10) || "
    + _PIN_SQL.format("'part-' || r || '-of-' || p", "section", "''", "coalesce(regions, '')")
    + """ AS t FROM y LEFT JOIN b USING (doc_id, section) WHERE k = 0
      UNION ALL SELECT doc_id, r, 'About ' || p || chr(10) FROM y WHERE k = 1
      UNION ALL SELECT doc_id, r, repeat('#', (2 + r % 2)::INTEGER) || ' Figure ' || r || ' with ' || p || chr(10) || chr(10) || """
    + _PIN_SQL.format("'figure-' || r || '-with-' || p", "asset", "'asset: fig_' || r || chr(10) || 'type: figure' || chr(10)", "'image: /assets/' || doc_id || '/' || r || '.png' || chr(10)")
    + """ || chr(10) || '![figure ' || r || '](/assets/' || doc_id || '/' || r || '.png)' || chr(10) || chr(10) || 'Figure ' || r || ' with ' || p || chr(10) FROM y WHERE k = 2)
    SELECT doc_id, string_agg(t, chr(10) ORDER BY r) AS markdown FROM h GROUP BY doc_id"""
)
def session_pages(spark, sf_dir):
    own = F.row_number().over(tree.W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), own.alias("region_no"), "l_partkey")
    r, part, k = F.col("region_no"), F.col("l_partkey"), (F.col("region_no") - 1) % 3
    regions = lines.select(
        "doc_id", "region_no", F.when(k == 0, "paragraph_title").when(k == 1, "text").otherwise("figure").alias("type"),
        F.when(k == 0, F.concat(F.lit("Part "), r, F.lit(" of "), part)).when(k == 1, F.concat(F.lit("About "), part)).alias("text"),
        F.floor(r / 4).cast("int").alias("page"), (10.0 * r).alias("x0"), (1.0 * r).alias("y0"), (10 * r + 5.5).alias("x1"), (r + 2.0).alias("y1"),
        F.when(k == 0, 1 + r % 2).alias("level"),
    )
    none = F.lit(None).cast("string")
    assets = lines.where(k == 2).select(
        "doc_id", "region_no", F.concat(F.lit("fig_"), r).alias("asset_id"), F.lit("figure").alias("type"), r.alias("number"),
        F.concat(F.lit("Figure "), r, F.lit(" with "), part).alias("caption"), F.concat(F.lit("crops/"), r, F.lit(".png")).alias("image"),
        none.alias("description"), none.alias("table_markdown"), F.lit(False).alias("is_icon"),
    )
    return session.session_markdown(regions, assets)


# ---- recorded answers and an archive's recall ----------------------------------------------------------------------------


@query(
    """SELECT conv_id, turn, 'a: ' || role AS short_answer, CASE WHEN turn % 2 = 0 THEN 'see STILL_NEEDED: x' || chr(10) || 'and ' || conv_id ELSE NULL END AS rationale,
    't' || turn AS still_needed FROM conversations"""
)
def recorded_answers(spark, sf_dir):
    """Turns as recorded answers; a label within a line is none, and of a label that comes twice the last counts."""
    even = F.concat(F.lit("RATIONALE: see STILL_NEEDED: x\nand "), "conv_id", F.lit("\n"))
    said = F.concat(F.lit("SHORT_ANSWER: old\n"), F.when(F.col("turn") % 2 == 0, even).otherwise(F.lit("")), F.lit("SHORT_ANSWER: a: "), "role", F.lit("\nSTILL_NEEDED:\tt"), "turn", F.lit("\n"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", text.recorded_answer(said).alias("a"))
    return rows.select("conv_id", "turn", "a.short_answer", "a.rationale", "a.still_needed")


@query(
    """WITH r AS (SELECT doc_id % 17 = 0 AS bad, coalesce(quality = 1, false) AS hit, n_chars % 4 AS rank, doc_id % 3 = 0 AS section, n_chars % 9 AS k FROM documents LEFT JOIN labels USING (doc_id)), f AS (SELECT * FROM r WHERE NOT bad)
    SELECT (SELECT count(*) FROM r) AS n, (SELECT count(*) FROM r WHERE bad) AS failed, count(*) FILTER (hit) AS hits, round(avg(hit::INTEGER), 4) AS recall, count(*) FILTER (hit AND rank = 1) AS at_rank_1,
      round(avg((hit AND rank = 1)::INTEGER), 4) AS recall_at_1, count(*) FILTER (section) AS section_queries, round(count(*) FILTER (hit AND section) / count(*) FILTER (section), 4) AS section_recall,
      round(avg(k), 2) AS returned_mean, median(k) AS returned_median, max(k) AS returned_max, sum(rank)::BIGINT AS not_verbatim, 0::BIGINT AS unknown_ids, count(*) FILTER (k = 5) AS parse_errors FROM f"""
)
def archive_recall(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.col("n_chars")
    return evaluate.archive_recall(
        docs.select(
            F.coalesce(F.col("quality") == 1, F.lit(False)).alias("gold_retrieved"), (n % 4).alias("gold_rank"), (F.col("doc_id") % 3 == 0).alias("section_level"), (n % 9).alias("n_returned"),
            (n % 4).alias("n_not_verbatim"), F.lit(0).alias("n_unknown"), (n % 9 == 5).alias("parse_error"), F.when(F.col("doc_id") % 17 == 0, "timeout").alias("error"),
        )
    )
