"""String functions as native columns. Patterns keep to classes that mean the same in Java and RE2."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking tokeniser.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "how", "in", "is", "it", "its", "of", "on",
    "or", "that", "the", "to", "was", "were", "what", "when", "where", "which", "who", "why", "will", "with",
]

CHARS_PER_TOKEN = 3.4
WHITE = r"[ \t\n\x0B\f\r]"


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: str | Column) -> Column:
    """Without white space at both ends, newlines included."""
    return F.regexp_replace(_col(x), f"^{WHITE}+|{WHITE}+$", "")


def squeeze(x: str | Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(x), f"{WHITE}+", " "))


def first_words(x: str | Column, n: int) -> Column:
    """The first n words, joined by one space."""
    return F.array_join(F.slice(F.filter(F.split(_col(x), f"{WHITE}+"), lambda w: w != ""), 1, n), " ")


def tokenize(x: str | Column) -> Column:
    """Ranking terms: runs of a-z and 0-9 of the lower-cased text, two characters or more, no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(x), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))  # a set, where an array would be walked for each word


def content_words(x: str | Column) -> Column:
    """Distinct runs of a-z and 0-9 of three characters or more: the loose matcher's words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(x), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 2))


def mentions(haystack: str | Column, needle: str | Column) -> Column:
    """Are at least half of the needle's words in the haystack? An empty needle is not mentioned."""
    words = content_words(needle)
    return (F.size(words) > 0) & (2 * F.size(F.array_intersect(words, content_words(haystack))) >= F.size(words))


def slug(x: str | Column) -> Column:
    """Lower-case runs of a-z and 0-9 joined by hyphens; empty if there are none."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(x)), "[^a-z0-9]+", "-"), "^-|-$", "")


def page_slug(x: str | Column) -> Column:
    """The reader's anchors: word characters, white space as single hyphens."""
    kept = F.regexp_replace(F.lower(strip(x)), r"[^A-Za-z0-9_ \t\n\x0B\f\r-]", "")
    return F.regexp_replace(kept, f"{WHITE}+", "-")


def sanitise(x: str | Column) -> Column:
    """A file-name part: unsafe runs as one underscore, no dots, underscores or hyphens at the ends."""
    clean = F.regexp_replace(F.regexp_replace(_col(x), "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")
    return F.when(clean == "", F.lit("untitled")).otherwise(clean)


def estimate_tokens(x: str | Column, ratio: float = CHARS_PER_TOKEN) -> Column:
    """0 for null or empty, otherwise the length over the ratio, cut, plus one."""
    length = F.char_length(F.coalesce(_col(x), F.lit("")))
    return F.when(length == 0, F.lit(0)).otherwise(F.floor(length / F.lit(ratio)) + 1).cast("long")


def leaf_cost(title: str | Column, content: str | Column) -> Column:
    return estimate_tokens(F.concat(_col(title), F.lit("\n"), F.coalesce(_col(content), F.lit("")))) + 16


def answer_budget(context: int, reserve: int, query: str | Column) -> Column:
    """Tokens that passages may take of an answer's context."""
    return F.greatest(F.lit(0), F.lit(context - reserve - 900) - estimate_tokens(query))


def clamp_context(context: Column, most: int, least: int = 4096) -> Column:
    return F.greatest(F.lit(least), F.least(context, F.lit(most)))


def leaf_hash(title: str | Column, content: str | Column) -> Column:
    return F.sha2(F.concat(_col(title), F.lit("\n"), F.coalesce(_col(content), F.lit(""))), 256)


def ranking_text(title: str | Column, summary: str | Column, content: str | Column) -> Column:
    return F.concat_ws("\n", *[F.coalesce(_col(c), F.lit("")) for c in (title, summary, content)])


def normalise_query(x: str | Column) -> Column:
    return F.lower(squeeze(x))


_QUOTES = {"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-"}


def fold_quotes(x: str | Column) -> Column:
    """Curly quotes and long dashes as plain ones."""
    return F.translate(_col(x), "".join(_QUOTES), "".join(_QUOTES.values()))


def normalise_quote(x: str | Column) -> Column:
    return F.lower(squeeze(fold_quotes(F.coalesce(_col(x), F.lit("")))))


def quote_is_verbatim(body: str | Column, quote: str | Column) -> Column:
    """Null where there is no such passage."""
    return F.when(_col(body).isNotNull(), F.contains(normalise_quote(body), normalise_quote(quote)))


def normalise_file(x: str | Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(_col(x), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


# The prefixes that titles are compared without.
TITLE_OUTLINE = "^[IVXLCDM]{2,7}(?:-[A-Z][0-9]*)*[ \\t]+(?=[A-Z0-9])|^[IVXLCDM]{1,7}(?:-[A-Z][0-9]*)+[ \\t]+(?=[A-Z0-9])"
TITLE_APPENDIX = "^[A-Z][ \\t]+(?=[A-Z0-9])"
TITLE_NUMBER = r"^(?:[0-9]+(?:\.[0-9]+)*[.)]?|[ivxlcdm]+[.)]|[a-z][.)]|[a-z]\.[0-9]+(?:\.[0-9]+)*[.)]?) +"


def normalise_title(x: str | Column) -> Column:
    """Headings for comparison: punctuation folded, numbering and emphasis dropped, lower case."""
    t = strip(F.translate(_col(x), "’‘“”–—‐ ", "''\"\"--- "))
    t = F.regexp_replace(F.regexp_replace(t, TITLE_OUTLINE, ""), TITLE_APPENDIX, "")
    t = squeeze(F.regexp_replace(F.lower(t), "[*`]+", ""))
    t = F.regexp_replace(t, TITLE_NUMBER, "")
    return F.regexp_replace(t, r"^[ .,:;\-#]+|[ .,:;\-#]+$", "")


def clean_node_id(x: str | Column) -> Column:
    """The node id in an echoed listing line: bullets, fields, kind words, paths and id= are dropped."""
    t = strip(F.regexp_replace(strip(x), "^[-*• ]+", ""))
    fields = F.transform(F.split(t, r"\|"), strip)
    named = F.get(F.filter(fields, lambda f: f.startswith("id=")), F.lit(0))
    first = F.get(fields, F.lit(0))
    plain = F.when(F.contains(t, F.lit("|")) & (first != ""), first).otherwise(t)
    plain = F.regexp_replace(plain, r"(?i)^(?:LEAF|SECTION|\[LEAF\]|\[SECTION\])[ \t\n\\:]+", "")
    plain = F.element_at(F.split(plain, "/"), -1)
    plain = F.regexp_replace(plain, "^id=", "")
    has_fields = F.contains(t, F.lit("|")) & named.isNotNull()
    return strip(F.when(has_fields, F.substr(named, F.lit(4))).otherwise(plain))


def normalise_answer_id(x: str | Column, known: list[str]) -> Column:
    """The known id an echoed answer stands for: a whole field, or else any id inside; null if none."""
    t = strip(F.regexp_replace(strip(x), "^[-*• ]+", ""))
    t = F.regexp_replace(t, "^[\"']+|[\"']+$", "")
    fields = F.concat(F.array(t), F.transform(F.split(t, r"\|"), strip))
    fields = F.concat(fields, F.transform(fields, lambda f: strip(F.regexp_replace(f, "^id=", ""))))
    ids = F.array(*[F.lit(k) for k in known]).cast("array<string>")
    exact = F.get(F.filter(fields, lambda f: F.array_contains(ids, f)), F.lit(0))
    inside = F.get(F.filter(ids, lambda k: F.contains(t, k)), F.lit(0))
    return F.coalesce(exact, inside)


def clean_model_text(x: str | Column) -> Column:
    """Without think blocks and fence lines, white space squeezed, outer double quotes dropped."""
    t = F.regexp_replace(_col(x), "(?s)<think>.*?</think>", "")
    t = F.regexp_replace(t, "(?m)^```.*?$", "")
    return F.regexp_replace(squeeze(t), '^"+|"+$', "")


def strip_thoughts(x: str | Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(_col(x), F.lit("")), "(?s)<thought>.*?(?:</thought>|$)", ""))


def sentences(x: str | Column) -> Column:
    """Split after . ; or : before white space."""
    return F.split(_col(x), f"(?<=[.;:]){WHITE}+")


def numbers(x: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_col(x), F.lit("[0-9]+(?:[.][0-9]+)?"), F.lit(0)))


def key_words(x: str | Column) -> Column:
    """Distinct lower-case words of three letters or more that are no stop words."""
    found = F.regexp_extract_all(F.lower(_col(x)), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*STOPWORDS)))


def block_text(x: str | Column) -> Column:
    """Text-layer clean-up: control marks and soft hyphens dropped, hyphenated line ends joined."""
    t = F.translate(_col(x), "\u0002­", "")
    return squeeze(F.regexp_replace(t, r"([A-Za-z0-9_])-\n([A-Za-z0-9_])", "$1$2"))


# Fixed value: how a text names a figure or a table.
MENTION = r"(?i)\b(fig(?:ure)?|tab(?:le)?)s?\.?[ \t]*([0-9]+)"


def figure_mentions(x: str | Column) -> Column:
    """array<struct<kind, number>> of figures and tables that the text names."""
    pattern = MENTION
    kinds = F.transform(
        F.regexp_extract_all(_col(x), F.lit(pattern), F.lit(1)),
        lambda k: F.when(F.lower(k).startswith("f"), F.lit("figure")).otherwise(F.lit("table")),
    )
    found = F.transform(F.regexp_extract_all(_col(x), F.lit(pattern), F.lit(2)), lambda n: n.cast("int"))
    return F.zip_with(kinds, found, lambda k, n: F.struct(k.alias("kind"), n.alias("number")))


def cited_numbers(x: str | Column) -> Column:
    """Every number in [n] and [n, m], in order."""
    groups = F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit(r"\[([0-9]+(?:[ \t\n]*,[ \t\n]*[0-9]+)*)\]"), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda p: strip(p).cast("int"))))


def grounding_status(answer: str | Column, n_sources: str | Column) -> Column:
    n = _col(n_sources)
    valid = F.exists(cited_numbers(answer), lambda c: (c >= 1) & (c <= n))
    return (
        F.when(n <= 0, F.lit("insufficient_evidence")).when(valid, F.lit("grounded")).otherwise(F.lit("partially_grounded"))
    )


def judgment_label(raw: str | Column) -> Column:
    r = _col(raw)
    return (
        F.when(r.isNull(), F.lit("missing"))
        .when(r.rlike(r"(?i)^[ \t\n]*\**[ \t\n]*yes\b"), F.lit("sufficient"))
        .when(r.rlike(r"(?i)^[ \t\n]*\**[ \t\n]*no\b"), F.lit("insufficient"))
        .otherwise(F.lit("unparsed"))
    )


def judgment_ui_reading(raw: str | Column) -> Column:
    said_no = F.coalesce(_col(raw), F.lit("")).rlike(r"(?i)^[ \t\n]*no\b")
    return F.when(said_no, F.lit("insufficient")).otherwise(F.lit("sufficient"))


def still_needed(raw: str | Column) -> Column:
    lines = F.filter(F.split(F.coalesce(_col(raw), F.lit("")), "\n"), lambda x: strip(x) != "")
    return F.transform(lines, lambda x: strip(F.regexp_replace(x, "^[ \t]*[-•*][ \t]*", "")))


def shorten(x: str | Column, n: int) -> Column:
    """At most n characters, with an ellipsis in place of what is cut."""
    return F.when(F.char_length(_col(x)) > n, F.concat(F.rtrim(F.substr(_col(x), F.lit(1), F.lit(n - 1))), F.lit("…"))).otherwise(_col(x))


def highlight(content: str | Column, quote: str | Column) -> Column:
    """The place to mark in a passage: the quote, or else its first sentence over 20 characters; null if neither is there."""
    body, low = _col(content), F.lower(_col(content))
    near = F.get(F.filter(F.split(_col(quote), r"(?<=[.!?])[ \t\n]+"), lambda s: F.char_length(s) > 20), F.lit(0))

    def found(needle: Column) -> Column:
        at = F.call_function("locate", F.lower(needle), low)
        return F.when((at > 0) & (needle != ""), F.substr(body, at, F.char_length(needle)))

    return F.coalesce(found(_col(quote)), found(near))


def fill(template: str, **values: Column) -> Column:
    """A prompt: NAME_PLACEHOLDER marks of a literal template replaced by columns, in the order given."""
    return reduce(
        lambda t, kv: F.replace(t, F.lit(f"{kv[0].upper()}_PLACEHOLDER"), F.coalesce(kv[1], F.lit(""))),
        values.items(),
        F.lit(template),
    )


# ---- usage and cost -------------------------------------------------------------------------


def fresh_tokens(total: Column, cached: Column, written: Column) -> Column:
    return F.greatest(F.lit(0), F.coalesce(total, F.lit(0)) - F.coalesce(cached, F.lit(0)) - F.coalesce(written, F.lit(0)))


def cost_usd(
    total: Column, cached: Column, written: Column, out: Column, rates: dict[str, dict[str, float]], threshold: int = 272_000
) -> Column:
    """Dollars of a call on the tier of its input size, at rates per million tokens."""

    def at(tier: str) -> Column:
        r = rates[tier]
        return (
            fresh_tokens(total, cached, written) * r["input"]
            + cached * r["cache_read"]
            + written * r["cache_write"]
            + out * r["output"]
        ) / 1e6

    return F.round(F.when(total > threshold, at("long")).otherwise(at("short")), 6)


def canonical_json(x: str | Column) -> Column:
    """JSON text with the keys of each object in order and without white space; null if it can't be parsed."""
    return F.to_json(F.try_parse_json(_col(x)))


def questions_fingerprint(x: str | Column) -> Column:
    """12 hex digits of a question set's content (JSON text): the order of keys and white space don't matter, any other edit does."""
    return F.substr(F.sha2(canonical_json(x), 256), F.lit(1), F.lit(12))


def judgement_key(questions: str | Column, version: str | Column, prompt_version: int) -> Column:
    """What a stored judgement depends on: the set's own version, the prompt's, and the set's content."""
    return F.concat(F.lit("v"), _col(version), F.lit(f"|p{prompt_version}|q"), questions_fingerprint(questions))


# The labels of a recorded answer, in capitals at the start of a line.
RECORDED = ["SHORT_ANSWER", "RECOMMENDED_ACTION", "RATIONALE", "LIMITATIONS", "EVIDENCE_SUFFICIENT", "STILL_NEEDED"]


def recorded_answer(x: str | Column) -> Column:
    """struct of a recorded answer's sections, each up to the next label that starts a line, the last of a label; null where it has none."""
    label = "|".join(RECORDED)

    def section(name: str) -> Column:
        found = F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit(rf"(?ms)^{name}:[ \t]*(.*?)(?=^(?:{label}):|\z)"), F.lit(1))
        return strip(F.get(found, F.size(found) - 1)).alias(name.lower())

    return F.struct(*[section(name) for name in RECORDED])
