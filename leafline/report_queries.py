"""Registered queries of reports, selections, arms, listings and parsers over the test tables, with DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.functions import parsing, text
from leafline.operators import evaluate, ingest, layout, prune, reports, tree
from leafline.queries import _PAIR_SQL, _RECORD_SQL, _UP_SQL, STOP_SQL, _records, _tree, query, read

# ---- report sections ------------------------------------------------------------------------


@query("SELECT coalesce(CASE event_type WHEN 'error' THEN 'context' WHEN 'click' THEN 'max_evals' END, 'none') AS capped_by, count(*) AS n FROM events GROUP BY 1")
def capped_by(spark, sf_dir):
    kind = F.col("event_type")
    return reports.capped_by(read(spark, sf_dir, "events").select(F.when(kind == "error", "context").when(kind == "click", "max_evals").alias("capped_by")))


def _outcomes(spark, sf_dir):
    return _records(spark, sf_dir).withColumnRenamed("doc_id", "id")


@query(
    f"""WITH m AS ({_RECORD_SQL}), r AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'retrieved' WHEN n_chars % 3 = 1 THEN 'rejected' ELSE 'deferred' END AS o FROM documents WHERE doc_id % 2 = 0)
    SELECT o AS gold_outcome, count(*) AS n, o = 'retrieved' AS recovered FROM m JOIN r USING (doc_id) WHERE gold_outcome IN ('deferred', 'deferred_judged_relevant') GROUP BY o"""
)
def raised_arm(spark, sf_dir):
    third = F.col("n_chars") % 3
    outcome = F.when(third == 0, "retrieved").when(third == 1, "rejected").otherwise("deferred")
    raised = read(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), outcome.alias("gold_outcome"))
    return reports.raised_arm(_outcomes(spark, sf_dir), raised)


@query(
    f"""WITH m AS ({_RECORD_SQL}), b AS (SELECT doc_id, n_chars % 50 AS gold_rank FROM documents WHERE doc_id % 3 != 0)
    SELECT gold_outcome, count(*) AS n, median(gold_rank) AS median_rank FROM m JOIN b USING (doc_id)
    WHERE gold_rank > 0 AND gold_outcome IN ('pruned', 'rejected', 'deferred') GROUP BY gold_outcome"""
)
def baseline_ranks(spark, sf_dir):
    baseline = read(spark, sf_dir, "documents").where("doc_id % 3 != 0").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 50).alias("gold_rank"))
    return reports.baseline_ranks(_outcomes(spark, sf_dir), baseline)


@query(f"SELECT count(*) AS n, round(avg(gold_retrieved::INTEGER), 4) AS recall FROM ({_RECORD_SQL}) WHERE gold_outcome NOT IN ('deferred', 'deferred_judged_relevant')")
def system_recall(spark, sf_dir):
    return reports.system_recall(_outcomes(spark, sf_dir))


_SIDES_SQL = _PAIR_SQL.replace("SELECT conv_id", "SELECT role, conv_id")


@query(
    f"""SELECT a.role AS label_a, b.role AS label_b, len(list_intersect(a.w, b.w)) = len(a.w) AND len(a.w) = len(b.w) AS same_set, count(*) AS n
    FROM ({_SIDES_SQL}) a JOIN ({_SIDES_SQL}) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0 GROUP BY ALL"""
)
def label_transitions(spark, sf_dir):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    even = F.col("turn") % 2 == 0
    key = F.concat_ws("-", "conv_id", F.col("turn") - F.col("turn") % 2)
    records = read(spark, sf_dir, "conversations").select(
        F.when(even, key).alias("id"), F.when(even, "A").otherwise("B").alias("set"), F.when(~even, key).alias("pair_id"),
        words.alias("retrieved"), F.lit(True).alias("gold_retrieved"), F.col("role").alias("label"),
    )
    return reports.transitions(evaluate.pair_drift(records))


@query(
    """SELECT CASE WHEN toxic = 1 THEN 'insufficient' ELSE 'sufficient' END AS label, count(*) AS n, count(*) FILTER (toxic = 1) AS passed,
    count(*) FILTER (quality = 1) AS grounded FROM labels GROUP BY 1"""
)
def forced_floor(spark, sf_dir):
    label = F.when(F.col("toxic") == 1, "insufficient").otherwise("sufficient")
    status = F.when(F.col("quality") == 1, "grounded").otherwise("partially_grounded")
    answers = read(spark, sf_dir, "labels").select(label.alias("label"), (F.col("toxic") == 1).alias("passed"), status.alias("grounding_status"))
    return reports.forced_floor(answers)


@query("SELECT row_number() OVER (ORDER BY line) + 1 AS line_no, line FROM (SELECT '- ' || lang || ': ' || count(*) AS line FROM documents GROUP BY lang) UNION ALL VALUES (0, '## Languages'), (1, '')")
def report_section(spark, sf_dir):
    facts = read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return reports.report_lines("Languages", facts, "lang", "n").withColumn("line_no", F.col("line_no").cast("long"))


@query("SELECT item_id || '.txt' AS name, 'Answer: ' || text AS prompt, sha256('Answer: ' || text) AS sha256 FROM benchmark")
def prompt_files(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark")
    return reports.prompt_files(items.select(F.col("item_id").cast("string").alias("id"), F.concat(F.lit("Answer: "), "text").alias("prompt")))


# ---- selections and listings ----------------------------------------------------------------


@query(
    """SELECT n_regionkey AS parent, lower(n_name) AS node_id, CASE WHEN n_regionkey % 2 = 1 THEN 'Kept after a failed selection call' ELSE 'key ' || n_nationkey END AS reason,
    n_regionkey % 2 = 1 AS errored FROM nation WHERE n_regionkey % 2 = 1 OR n_nationkey % 3 = 0"""
)
def selection_fallback(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").withColumn("node_id", F.lower("n_name"))
    entry = F.concat(F.lit('{"id": "- '), "node_id", F.lit(' | LEAF", "reason": " key '), "n_nationkey", F.lit(' "}'))
    listed = F.concat(F.lit('{"keep": ["unknown", '), F.array_join(F.collect_list(F.when(F.col("n_nationkey") % 3 == 0, entry)), ", "), F.lit("]}"))
    batches = nation.groupBy("n_regionkey").agg(listed.alias("l")).select(
        F.col("n_regionkey").alias("parent"), F.lit(0).alias("batch"), F.when(F.col("n_regionkey") % 2 == 0, F.col("l")).otherwise(F.lit("I can not tell.")).alias("reply")
    )
    return prune.parse_selection(batches, nation.select(F.col("n_regionkey").alias("parent"), F.lit(0).alias("batch"), "node_id"))


@query(r"SELECT doc_id FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 80")
def eligible_leaves(spark, sf_dir):
    return reports.eligible(read(spark, sf_dir, "documents"), "text").select("doc_id")


@query(f"SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM ({_RECORD_SQL}) WHERE gold_outcome IN ('deferred', 'deferred_judged_relevant'))")
def deferred_before(spark, sf_dir):
    return reports.deferred_before(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), _outcomes(spark, sf_dir))


@query(
    rf"""WITH src AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
    asked AS (SELECT item_id AS id, source, item_id % 9 AS page, list_distinct(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)?')) AS nums,
      list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda w: NOT list_contains({STOP_SQL}, w))) AS words FROM benchmark JOIN src ON i = item_id % (SELECT count(*) FROM src)),
    parts AS (SELECT doc_id, source, doc_id % 7 AS page, string_split(regexp_replace(text, '([.;:])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
    split AS (SELECT doc_id, source, page, unnest(s) AS sentence, generate_subscripts(s, 1) AS no FROM parts),
    hits AS (SELECT id, doc_id, no, abs(split.page - asked.page) <= 1 OR abs(split.page + 1 - asked.page) <= 1 AS near,
      5 * len(list_filter(nums, lambda x: contains(lower(sentence), x))) + len(list_filter(words, lambda x: contains(lower(sentence), x)))
      + CASE WHEN regexp_matches(sentence, '[0-9]') THEN 2 ELSE 0 END AS score FROM asked JOIN split ON split.source = asked.source),
    best AS (SELECT id, arg_min({{'c': doc_id, 's': score, 'n': near}}, (-score, doc_id, no)) AS a, arg_min({{'c': doc_id, 's': score}}, (-score, doc_id, no)) FILTER (near) AS k FROM hits WHERE score > 0 GROUP BY id)
    SELECT asked.id, CASE WHEN a IS NULL THEN 'NONE' WHEN k.s >= 8 THEN 'OK' WHEN a.n THEN 'WEAK' ELSE 'OFFPAGE' END AS verdict,
      CASE WHEN k.s >= 8 THEN k.c ELSE a.c END AS chunk_id, coalesce(CASE WHEN k.s >= 8 THEN k.s ELSE a.s END, 0)::INTEGER AS score FROM asked LEFT JOIN best USING (id)"""
)
def sentence_verdict(spark, sf_dir):
    """Each item's sentence among all documents of a source."""
    docs = read(spark, sf_dir, "documents")
    sources = docs.where("source IS NOT NULL").select("source").distinct().withColumn("i", F.row_number().over(tree.W.orderBy("source")) - 1)  # a row a source
    n = sources.count()
    asked = read(spark, sf_dir, "benchmark").withColumn("i", F.col("item_id") % max(1, n)).join(sources, "i").select(
        F.col("item_id").alias("id"), F.col("source").alias("doc"), F.col("text").alias("question"), (F.col("item_id") % 9).alias("page")
    )
    page = F.col("doc_id") % 7
    chunks = docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("chunk_id"), F.array(page, page + 1).alias("pages"), F.col("text").alias("body"))
    return reports.sentence_verdicts(asked, chunks)


@query(
    """SELECT source AS doc_id, count(*) AS leaves, count(*) FILTER (quality = 1) AS retrieved, floor(100 * count(*) FILTER (quality = 1) / count(*) + 0.5)::BIGINT AS percent
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"""
)
def retrieval_ratio(spark, sf_dir):
    good = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("retrieved"))
    leaves = read(spark, sf_dir, "documents").join(good, "doc_id", "left")
    return reports.retrieval_ratio(leaves.select(F.col("source").alias("doc_id"), F.coalesce("retrieved", F.lit(False)).alias("retrieved")))


@query(
    """SELECT o_custkey AS run_id, o_orderkey AS node_id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 5 END NULLS LAST, o_orderkey)::INTEGER AS place
    FROM orders WHERE o_orderkey % 3 = 0"""
)
def deferred_listing(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 5)
    status = F.when(F.col("o_orderkey") % 3 == 0, "deferred").otherwise("retrieved")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("node_id"), status.alias("status"), rank.alias("rank"))
    return reports.deferred_listing(rows, ["run_id"]).select("run_id", "node_id", "place")


@query("SELECT doc_id AS id, n_chars AS rank FROM documents ORDER BY n_chars DESC, doc_id LIMIT 8")
def worst_ranks(spark, sf_dir):
    return reports.worst(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("rank")))


@query("SELECT user_id AS run_id, max(ts) AS started FROM events GROUP BY user_id ORDER BY started DESC, run_id LIMIT 32")
def kept_runs(spark, sf_dir):
    return reports.kept_runs(read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.max("ts").alias("started")))


@query(
    _UP_SQL
    + """, whole AS (SELECT up.doc_id, up.of, up.crumb, t.title FROM up JOIN tree t ON t.doc_id = up.doc_id AND t.node_seq = up.of WHERE up.parent_seq IS NULL)
    SELECT doc_id, arg_min(crumb, of) AS breadcrumb FROM whole WHERE lower(title) = 'machinery' GROUP BY doc_id"""
)
def title_breadcrumb(spark, sf_dir):
    return reports.find_breadcrumb(tree.with_ancestors(_tree(spark, sf_dir)), "2. **Machinery** ")


_OWN_SQL = "CASE WHEN node_seq % 13 = 0 THEN 'retrieved' WHEN node_seq % 7 = 0 THEN 'rejected' WHEN node_seq % 5 = 0 THEN 'pruned' END"


@query(
    _UP_SQL
    + f"""SELECT doc_id, of AS node_seq, CASE WHEN bool_or(s = 'retrieved') THEN 'retrieved' WHEN bool_or(s = 'rejected') THEN 'rejected' WHEN bool_or(s = 'pruned') THEN 'pruned' ELSE 'pending' END AS status
    FROM (SELECT *, {_OWN_SQL} AS s FROM up) GROUP BY doc_id, of"""
)
def inherited_status(spark, sf_dir):
    full = tree.with_ancestors(_tree(spark, sf_dir))
    return reports.inherited_status(full, full.select("doc_id", "node_seq", F.expr(_OWN_SQL).alias("status")).where("status IS NOT NULL"))


@query(
    """SELECT 'p' || p_partkey AS doc_id, 'p' || p_partkey AS title, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '/in/' || p_type || '/' || p_name || '.pdf' END AS source_path,
    CASE WHEN p_partkey % 3 = 0 THEN 'p' || p_partkey || '.md' ELSE p_name || '.pdf' END AS rel_path, p_brand AS ingest_module, 0 AS n_tags FROM part"""
)
def legacy_manifest(spark, sf_dir):
    pdf = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("/in/"), "p_type", F.lit("/"), "p_name", F.lit(".pdf")))
    old = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("stem"), pdf.alias("pdf"), F.col("p_brand").alias("module"))
    rows = reports.manifest_of(None, old)
    return rows.select("doc_id", "title", "source_path", "rel_path", "ingest_module", (F.size("tags") + F.size("manual_tags")).alias("n_tags"))


@query("SELECT DISTINCT lang || doc_id AS stem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unindexed_stems(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat("lang", "doc_id").alias("stem"))
    return reports.unindexed(docs, docs.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id"))


@query(
    """SELECT a.conv_id || '-' || a.turn AS id, a.role, b.text AS b_text, c.text AS c_text FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
    LEFT JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn + 2 WHERE a.turn % 3 = 0"""
)
def cases_abc(spark, sf_dir):
    """Every three turns in a row of a conversation as the A, B and C row of a case."""
    turns = read(spark, sf_dir, "conversations").withColumn("k", F.col("turn") % 3)
    named = F.concat_ws("-", "conv_id", F.col("turn") - F.col("k"))
    of = lambda n: turns.where(F.col("k") == n).select(named.alias("pair_id"), F.col("turn").alias("id"), "text")
    a = turns.where("k = 0").select(named.alias("id"), "role")
    return reports.cases(a, of(1), of(2)).select("id", "role", F.col("b.text").alias("b_text"), F.col("c.text").alias("c_text"))


@query("SELECT 'fresh' AS run_id, event_id AS node_id, event_type AS status, ts FROM events WHERE event_type = 'error'")
def replayed_run(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("run_id"), F.col("event_id").alias("node_id"), F.col("event_type").alias("status"), "ts")
    return reports.replay(events, "error", "fresh")


# ---- parsers over whole tables --------------------------------------------------------------


@query(
    """SELECT c_mktsegment AS doc_id, c_custkey AS n, (CASE WHEN c_custkey % 4 = 0 THEN 1 WHEN c_custkey % 4 = 1 THEN 2 WHEN c_custkey % 4 = 2 THEN 3 ELSE 1 END)::INTEGER AS level FROM customer"""
)
def legacy_levels(spark, sf_dir):
    key = F.col("c_custkey")
    title = F.when(key % 4 == 0, F.concat(key, F.lit(" "), "c_name")).when(key % 4 == 1, F.concat(key, F.lit(".2 "), "c_name"))
    title = title.when(key % 4 == 2, F.concat(F.lit("("), key, F.lit(") "), "c_name")).otherwise(F.concat(F.lit("About "), "c_name"))
    rows = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("doc_id"), key.alias("n"), title.alias("title"), F.lit(None).cast("double").alias("size"))
    return layout.legacy_levels(rows)


@query("SELECT c_nationkey AS doc_id, c_custkey AS n, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 6 DESC)::INTEGER AS level FROM customer")
def legacy_size_levels(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("n"), F.col("c_name").alias("title"), (F.col("c_custkey") % 6 + 1).cast("double").alias("size")
    )
    return layout.legacy_levels(rows)


@query("SELECT s_suppkey AS id, s_suppkey AS page, s_acctbal AS scale, [s_suppkey + 0.5, 2.0]::DOUBLE[] AS bbox, s_name AS asset FROM supplier")
def typed_pins(spark, sf_dir):
    body = F.concat(
        F.lit("page: "), "s_suppkey", F.lit("\nscale:"), "s_acctbal", F.lit("\nbbox: ["), F.col("s_suppkey") + F.lit(0.5), F.lit(", 2]\nasset: "), "s_name"
    )
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), tree.pin_values(body).alias("p"))
    return rows.select("id", F.col("p.page.whole").alias("page"), F.col("p.scale.number").alias("scale"), F.col("p.bbox.list").alias("bbox"), F.col("p.asset.text").alias("asset"))


def _replies(spark, sf_dir) -> DataFrame:
    """Turns of conversations as labelled answers."""
    said = F.element_at(F.array(F.lit("yes"), F.lit("No, partly"), F.lit("maybe")), (F.col("turn") % 3 + 1).cast("int"))
    parts = [F.lit("SHORT_ANSWER: a [1] b [2, "), "conv_id", F.lit("]\n**Evidence sufficient:** "), said, F.lit("\n## still needed\n- "), "role", F.lit("\n• t"), "turn"]
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(*parts).alias("t"))


@query(
    """SELECT conv_id, turn, 'a [1] b [2, ' || conv_id || ']' AS short_answer, ['sufficient', 'insufficient', 'unparsed'][turn % 3 + 1] AS label,
    CASE WHEN turn % 3 = 1 THEN 'insufficient' ELSE 'sufficient' END AS ui_reading, [role, 't' || turn] AS still_needed FROM conversations"""
)
def answer_sections(spark, sf_dir):
    rows = _replies(spark, sf_dir).withColumn("s", parsing.sections_of(F.col("t")))
    raw = F.element_at("s", "evidence_sufficient")
    return rows.select(
        "conv_id", "turn", F.element_at("s", "short_answer").alias("short_answer"), text.judgment_label(raw).alias("label"),
        text.judgment_ui_reading(raw).alias("ui_reading"), text.still_needed(F.element_at("s", "still_needed")).alias("still_needed"),
    )


#: Turns with their whole text as answers that cite in one way or another, or not at all, and a number of sources from 0 to 4.
_CITING_SQL = r"""SELECT conv_id, turn, (conv_id + turn) % 5 AS n, coalesce(text, '') || CASE (conv_id + 2 * turn) % 4 WHEN 0 THEN ' see [1] and [2, ' || conv_id || '].' WHEN 1 THEN ' none [' || (turn + 9) || ']'
  WHEN 2 THEN ' [' || (turn + 1) || chr(10) || ', 12 ,3] and [x, 1] [ 4]' ELSE '' END AS t FROM conversations"""
_CITED_SQL = rf"""SELECT *, list_transform(flatten(list_transform(regexp_extract_all(t, '\[([0-9]+(?:[ \t\n]*,[ \t\n]*[0-9]+)*)\]', 1), lambda g: string_split(g, ','))),
  lambda p: trim(p, ' ' || chr(9) || chr(10))::INTEGER) AS cited FROM ({_CITING_SQL})"""


def _citing(spark, sf_dir) -> DataFrame:
    kind, turn = (F.col("conv_id") + 2 * F.col("turn")) % 4, F.col("turn")
    told = F.when(kind == 0, F.concat(F.lit(" see [1] and [2, "), "conv_id", F.lit("]."))).when(kind == 1, F.concat(F.lit(" none ["), turn + 9, F.lit("]")))
    told = told.when(kind == 2, F.concat(F.lit(" ["), turn + 1, F.lit("\n, 12 ,3] and [x, 1] [ 4]"))).otherwise(F.lit(""))
    answer = F.concat(F.coalesce("text", F.lit("")), told)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.col("conv_id") + turn) % 5).alias("n"), answer.alias("t"))


@query(f"SELECT conv_id, turn, cited FROM ({_CITED_SQL})")
def cited_numbers(spark, sf_dir):
    return _citing(spark, sf_dir).select("conv_id", "turn", text.cited_numbers("t").alias("cited"))


@query(
    f"""SELECT conv_id, turn, CASE WHEN n <= 0 THEN 'insufficient_evidence' WHEN len(list_filter(cited, lambda c: c BETWEEN 1 AND n)) > 0 THEN 'grounded'
    ELSE 'partially_grounded' END AS status FROM ({_CITED_SQL})"""
)
def grounding(spark, sf_dir):
    return _citing(spark, sf_dir).select("conv_id", "turn", text.grounding_status("t", "n").alias("status"))


@query("""SELECT p_partkey AS id, p_brand || '-' || p_partkey AS node_id FROM part""")
def clean_node_id(spark, sf_dir):
    key = F.concat("p_brand", F.lit("-"), "p_partkey")
    nth = F.col("p_partkey") % 5
    raw = F.when(nth == 0, F.concat(F.lit("- "), key)).when(nth == 1, F.concat(F.lit("id="), key, F.lit(" | LEAF | "), "p_name"))
    raw = raw.when(nth == 2, F.concat(F.lit("LEAF: "), key)).when(nth == 3, F.concat("p_type", F.lit("/"), key)).otherwise(key)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.clean_node_id(raw).alias("node_id"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 2 THEN '["' || s_name || '", "b"]' ELSE '{"quote": "the \\"' || s_name || '\\" x", "relevant": true}' END AS value FROM supplier""")
def json_repair(spark, sf_dir):
    kind, name = F.col("s_suppkey") % 3, F.col("s_name")
    stray = F.concat(F.lit('{"quote": "the "'), name, F.lit('" x", "relevant": true}'))
    fenced = F.concat(F.lit('<think>no</think>```json\n{"quote": "the \\"'), name, F.lit('\\" x", "relevant": true}\n```'))
    open_ended = F.concat(F.lit('{"keep": ["'), name, F.lit('", "b"'))
    raw = F.when(kind == 0, stray).when(kind == 1, fenced).otherwise(open_ended)
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), parsing.json_of(raw).alias("value"))


@query(
    r"""SELECT s_suppkey AS id, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || s_name || ' \| x | ' || s_suppkey || ' |' || chr(10) || '|  | & |' AS markdown FROM supplier"""
)
def html_table(spark, sf_dir):
    html = F.concat(
        F.lit("<p>before</p><table><tr><th>name<th>name</th><th>key</th></tr><tr><td rowspan='2'><b>"), "s_name",
        F.lit("</b> | x</td>\n<td>"), "s_suppkey", F.lit("</td></tr><tr><td>&amp;</td></tr></table>"),
    )
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), parsing.markdown_of(html).alias("markdown"))


@query(
    """WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r, count(*) OVER (PARTITION BY l_orderkey) AS k FROM lineitem)
    SELECT doc_id, (r * 4 + i)::INTEGER AS n, CASE WHEN i < 3 THEN i + 1 END::INTEGER AS level, CASE WHEN i = 3 THEN 'none' WHEN i = 0 THEN 'high' WHEN k > 1 THEN 'med' ELSE 'low' END AS confidence
    FROM l CROSS JOIN (VALUES (0), (1), (2), (3)) v(i)"""
)
def heading_levels(spark, sf_dir):
    """An order's lines as numbered sections of a document, below each a letter and a number in brackets that begin again."""
    nth = F.row_number().over(tree.W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows, key = read(spark, sf_dir, "lineitem").withColumn("r", nth), F.col("l_partkey").cast("string")
    titles = F.array(F.concat("r", F.lit(". Part "), key), F.concat(F.lit("A. Price of "), key), F.concat(F.lit("(1) Tax of "), key), F.concat(F.lit("About "), key))
    heads = rows.select(F.col("l_orderkey").alias("doc_id"), "r", F.posexplode(titles).alias("i", "title"))
    return layout.heading_levels(heads.select("doc_id", (F.col("r") * 4 + F.col("i")).cast("int").alias("n"), "title"))


# ---- from blocks to documents ---------------------------------------------------------------

#: Customers as blocks of a document for each nation: every fourth is a title, of level 1 or 2 in turns, some without a level.
_BLOCK_SQL = """SELECT *, is_title AND level IS NOT NULL AS head FROM (
    SELECT c_nationkey AS doc_id, c_custkey AS n, (c_custkey % 3)::INTEGER AS page, (c_custkey % 7)::DOUBLE AS y0, c_custkey % 4 = 0 AS is_title,
    CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE ((c_custkey // 4) % 2 + 1)::INTEGER END AS level, c_name AS text FROM customer)"""
#: Their leaves with text.
_CONTENT_SQL = f"""WITH b AS ({_BLOCK_SQL}), m AS (
    SELECT *, max(CASE WHEN head THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS section, bool_or(head) OVER (PARTITION BY doc_id) AS headed,
    min(CASE WHEN head AND page = 0 THEN y0 END) OVER (PARTITION BY doc_id) AS top FROM b),
  own AS (SELECT doc_id, section, string_agg(text, ' ' ORDER BY n) AS content FROM m
    WHERE NOT head AND NOT (headed AND (section IS NULL OR coalesce(page = 0 AND y0 < top, false))) GROUP BY ALL),
  heads AS (SELECT doc_id, n AS section, text AS title, level, coalesce(lead(level) OVER (PARTITION BY doc_id ORDER BY n) > level, false) AS inside FROM b WHERE head)
  SELECT o.doc_id, title, (coalesce(level, 1) + coalesce(inside, false)::INTEGER)::INTEGER AS heading_level, coalesce(inside, false) AS synthetic, content
  FROM own o LEFT JOIN heads h ON o.doc_id = h.doc_id AND o.section = h.section"""


def _content(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    level = F.when(key % 20 != 0, (F.floor(key / 4) % 2 + 1).cast("int"))
    blocks = read(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("doc_id"), key.alias("n"), (key % 3).cast("int").alias("page"), (key % 7).cast("double").alias("y0"),
        (key % 4 == 0).alias("is_title"), level.alias("level"), F.col("c_name").alias("text"),
    )
    return ingest.content_tree(blocks)


@query(_CONTENT_SQL)
def content_leaves(spark, sf_dir):
    return _content(spark, sf_dir).where("is_leaf").select("doc_id", "title", "heading_level", "synthetic", "content")


@query(f"SELECT doc_id, sum(length(content))::BIGINT AS n_content, count(*) AS n_leaves FROM ({_CONTENT_SQL}) GROUP BY doc_id")
def tree_markdown_lengths(spark, sf_dir):
    made = ingest.tree_markdown(_content(spark, sf_dir))
    body = F.filter(F.split("markdown", "\n"), lambda x: ~x.startswith("#") & (x != ""))
    return made.select("doc_id", F.aggregate(body, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_content"), F.size(body).cast("long").alias("n_leaves"))


@query(
    """WITH c AS (SELECT c_nationkey AS doc_id, count(*) AS k FROM customer GROUP BY 1)
    SELECT n_nationkey AS doc_id, (CASE WHEN k IS NULL THEN -1 WHEN n_nationkey % 4 = 3 THEN 0 WHEN n_nationkey % 4 = 0 THEN 1
      WHEN n_nationkey % 2 = 0 THEN 4 ELSE 5 END)::INTEGER AS rung,
    (CASE WHEN k IS NULL THEN 0 WHEN n_nationkey % 4 = 3 THEN 1 ELSE k END)::INTEGER AS n_headings
    FROM nation LEFT JOIN c ON n_nationkey = doc_id"""
)
def ladder_rungs(spark, sf_dir):
    nation, customer = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    kind = F.col("c_nationkey") % 4
    title = F.when(kind == 0, F.concat("c_custkey", F.lit(".1 "), "c_name")).otherwise(F.concat(F.lit("About "), "c_name"))
    heads = customer.select(
        F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("n"), title.alias("title"), (F.col("c_custkey") % 3 + 9).cast("double").alias("size"), F.lit(4).alias("weight")
    )
    doc_id = F.col("n_nationkey").alias("doc_id")
    outlines = nation.select(
        doc_id, F.when(F.col("n_nationkey") % 4 == 3, "full").otherwise("titles_only").alias("verdict"), F.array(F.struct(F.col("n_name").alias("title"), F.lit(0).alias("level"))).alias("entries")
    )
    per = heads.groupBy("doc_id").agg(F.count("*").cast("int").alias("k"))
    reply = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array_repeat(F.lit(2), F.col("k")))).otherwise("no idea")
    out = ingest.ladder(nation.select(doc_id), heads, outlines, per.select("doc_id", reply.alias("reply")))
    return out.select("doc_id", "rung", F.coalesce(F.size("headings"), F.lit(0)).alias("n_headings"))


@query(
    """SELECT p_partkey AS n, CASE WHEN icon THEN 'Likely icons/broken infographics' WHEN n_real < 2 THEN NULL WHEN kinds > 1 THEN 'Figures and tables'
      WHEN tables > 0 THEN 'Tables' ELSE 'Figures' END AS "group", (CASE WHEN icon OR n_real < 2 THEN 3 ELSE 4 END)::INTEGER AS heading_level
    FROM (SELECT p_partkey, section, icon, t.n_real, t.kinds, t.tables FROM (SELECT *, p_partkey // 3 AS section, p_size % 5 = 0 AS icon FROM part) p
      JOIN (SELECT p_partkey // 3 AS section, count(*) FILTER (p_size % 5 != 0) AS n_real, count(DISTINCT p_size % 2) FILTER (p_size % 5 != 0) AS kinds,
        count(*) FILTER (p_size % 5 != 0 AND p_size % 2 = 0) AS tables FROM part GROUP BY 1) t USING (section))"""
)
def asset_groups(spark, sf_dir):
    size = F.col("p_size")
    assets = read(spark, sf_dir, "part").select(
        F.lit(0).alias("doc_id"), F.floor(F.col("p_partkey") / 3).alias("section"), F.lit(2).alias("level"), F.col("p_partkey").alias("n"),
        F.when(size % 2 == 0, "table").otherwise("figure").alias("type"), (size % 5 == 0).alias("is_icon"),
    )
    return ingest.asset_groups(assets).select("n", "group", "heading_level")


@query(
    """SELECT conv_id AS chat_id, conv_id || '-' || turn AS answer_id, 'Answer ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS label,
    CASE WHEN turn % 3 = 1 THEN 'grounded' ELSE 'not_connected' END AS status, (turn % 3)::INTEGER AS n_sources FROM conversations WHERE role = 'assistant'"""
)
def evidence_groups(spark, sf_dir):
    third = F.col("turn") % 3
    sources = F.filter(F.array(F.lit(1), F.lit(2)), lambda x: x <= third)
    rows = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("chat_id"), F.col("turn").alias("pos"), F.concat_ws("-", "conv_id", "turn").alias("id"), "role", F.col("text").alias("query"),
        F.when(third == 1, "grounded").alias("status"), F.when(third > 0, sources).alias("sources"),
    )
    return reports.evidence_groups(rows).drop("query")


@query("""SELECT p_partkey AS id, p_name AS question FROM part WHERE contains(lower(p_name), 'e') AND p_size % 2 = 0 ORDER BY p_retailprice, p_partkey LIMIT 8""")
def suggestions(spark, sf_dir):
    even = F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd")
    cases = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("pos"), F.col("p_name").alias("question"), even.alias("category"))
    return reports.suggestions(cases, " E ", "even").select("id", "question")


@query(
    """SELECT s_suppkey AS doc_id, ['whole', 'section-1', 'section-2'][s_suppkey % 3 + 1] AS node_id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey::VARCHAR ELSE s_name END AS title,
    CASE s_suppkey % 3 WHEN 0 THEN 'only ' || s_name WHEN 1 THEN 'body ' || s_suppkey ELSE 'a' || chr(10) || 'b' END AS excerpt FROM supplier"""
)
def document_passages(spark, sf_dir):
    kind, name = F.col("s_suppkey") % 3, F.col("s_name")
    plain, one = F.concat(F.lit("\nonly "), name, F.lit(" ")), F.concat(F.lit("# "), name, F.lit("\n\nbody "), "s_suppkey", F.lit("\n"))
    two = F.concat(F.lit("before\n# Empty\n\n## "), name, F.lit("\na\nb"))
    return tree.passages(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.when(kind == 0, plain).when(kind == 1, one).otherwise(two).alias("text")))
