"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes
and identifier cues. Each anchor is handed to a local parser that expands it to the
left and right, validates what it finds and says how far it has read, so every
kind's spans are the leftmost non-overlapping ones. Parsers look at the neighbourhood of
their anchor only, and read no character twice for one kind, so time is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.common import table, text_key

#: Kinds in the order of equal starts; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "secret")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+")
_IBAN = re.compile(r"[\s:#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SECRET = re.compile(r"\s{0,3}[=:]\s{0,3}[\"']([A-Za-z0-9_\-]{20,})[\"']")

Found = tuple[int, int] | None


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _only_digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


# A parser takes (text, anchor's start, anchor's end, where its kind has read to) and returns
# (span or None, where it has read to).


def _email(text: str, at: int, end: int, done: int) -> tuple[Found, int]:
    start = at
    while start > done and text[start - 1] in _LOCAL:
        start -= 1
    m = _DOMAIN.match(text, end) if start < at else None
    return ((start, m.end()), m.end()) if m else (None, done)


def _ip(text: str, at: int, end: int, done: int) -> tuple[Found, int]:
    m = _IP.match(text, at)
    if not m:  # a start later in the same digits meets the same dots
        return None, _DIGITS.match(text, at).end()
    fine = all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split("."))
    return (m.span() if fine else None), m.end()


def _card(text: str, at: int, end: int, done: int) -> tuple[Found, int]:
    m = _CARD.match(text, at)
    if not m:
        return None, end
    digits = _only_digits(m[0])
    return (m.span() if 14 <= len(digits) <= 19 and luhn(digits) else None), m.end()


def _phone(text: str, at: int, end: int, done: int) -> tuple[Found, int]:
    m = _PHONE.match(text, at)
    if not m:
        return None, end
    return (m.span() if 10 <= len(_only_digits(m[0])) <= 15 else None), m.end()


def _login(text: str, at: int, end: int, done: int) -> tuple[Found, int]:
    """scheme://user:password@host, from the scheme on."""
    m = _LOGIN.match(text, end)
    return ((at, m.end()), m.end()) if m else (None, end)


def _iban(text: str, at: int, end: int, done: int) -> tuple[Found, int]:
    """An account number after its cue, whose check digits are right."""
    m = _IBAN.match(text, end)
    if not m:
        return None, end
    plain = m[1].replace(" ", "")
    number = int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4]))
    return (m.span(1) if number % 97 == 1 else None), m.end()


def _secret(text: str, at: int, end: int, done: int) -> tuple[Found, int]:
    """A quoted credential that is assigned to its cue."""
    m = _SECRET.match(text, end)
    return (m.span(1), m.end()) if m else (None, end)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    anchors: dict[str, tuple[tuple[str, Callable], ...]] = {"@": (("email", _email),), "+": (("phone", _phone),)}
    anchors |= {str(d): (("ip", _ip), ("card", _card)) for d in range(10)}
    anchors |= {s: (("login", _login),) for s in ("http://", "https://", "ftp://", "ssh://")}
    anchors |= {s: (("iban", _iban),) for s in ("IBAN", "iban", "Iban")}
    anchors |= {
        form: (("secret", _secret),)
        for s in ("token", "secret", "password", "api_key", "apikey")
        for form in (s, s.upper(), s.capitalize())
    }
    made = ahocorasick.Automaton()
    for anchor, parsers in anchors.items():
        made.add_word(anchor, (len(anchor), parsers))
    made.make_automaton()
    return made


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind; none for a null text."""
    if not text:
        return []
    out, done = [], dict.fromkeys(KINDS, 0)
    for last, (length, parsers) in _automaton().iter(text):
        at = last + 1 - length
        for kind, parse in parsers:
            if at >= done[kind]:
                found, done[kind] = parse(text, at, last + 1, done[kind])
                if found:
                    out.append((kind, *found))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_key, spans array<struct<kind, start, end>>), one row for each row of docs.

    A null or empty text has no spans. Repeated rows appear as often as given, null doc_ids
    are carried, other columns are not looked at; spans of different kinds may overlap,
    those of one kind never. An empty table gives an empty result.
    """
    kind = "array<struct<kind: string, start: long, end: long>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t.as_py())] for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, arrow)], names=["doc_id", "text_key", "spans"]
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text))
    return source.mapInArrow(run, f"doc_id long, text_key long, spans {kind}")


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets."""
    if not text:
        return text
    out, end = [], 0
    for kind, start, stop in spans(text):
        if start >= end:
            out += [text[end:start], f"<{kind}>"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets; row by row, without a shuffle.

    Of overlapping spans the first replaces its characters, and the rest of the others goes with it. Null and empty
    texts, all other columns and repeated rows stay as they are; an empty table gives an empty result.
    """

    @F.arrow_udf("string")
    def clean(values: pa.Array) -> pa.Array:
        return pa.array([redacted(t) for t in values.to_pylist()], pa.string())

    return docs.withColumn(text, clean(F.col(f"`{text}`")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(listed):
        return F.concat_ws(
            ",", F.transform(listed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        )

    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(digest(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )
