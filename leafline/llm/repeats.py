"""Periodic runs of words, by the method of Kolpakov and Kucherov.

A run (start, length, period) is a stretch of words whose smallest period is ``period``, that no neighbouring word extends, and
that is long enough (EXPONENT periods and LEAST words). The words are cut into Lempel-Ziv factors with a suffix
automaton: each factor is the longest prefix of the rest that starts at an earlier place too. Main's algorithm
then finds the runs that touch a factor's start, and the runs inside a factor are copied from where its text stood before.

Why these are all: take a run of period p that ends in factor u (from b on) and starts at or before b. What it has beyond its
first period occurs p words earlier, so if it had its second period at or before the previous factor's start, that
factor would have been longer. So the run starts less than 2 |previous| + |u| words before b, which is as far as the window reaches.
A run in the inside of a factor stands in the same surroundings at the factor's earlier place, which is left of it.

Before that, the text is cut where no run can be: every three words in a row that lie in a run come back at each
period, so those that come back less often than the exponent asks (``least_returns``) part the text into stretches, and no run
reaches over such a place. This loses nothing, and a text without repeats costs one sort.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.common import table, words

#: Least number of periods and of words in a run.
EXPONENT = 4
LEAST = 6

Run = tuple[int, int, int]


class Automaton:
    """Suffix automaton: goes by state and symbol, with the end of each state's first occurrence."""

    def __init__(self, symbols: Sequence[int]) -> None:
        self.goes: list[dict[int, int]] = [{}]
        self.first_end = [-1]
        longest, link, last = [0], [-1], 0
        for at, symbol in enumerate(symbols):
            new, state = len(self.goes), last
            self.goes.append({})
            self.first_end.append(at)
            longest.append(at + 1)
            while state >= 0 and symbol not in self.goes[state]:
                self.goes[state][symbol] = new
                state = link[state]
            suffix = self.goes[state][symbol] if state >= 0 else 0
            if state >= 0 and longest[suffix] > longest[state] + 1:  # only its shorter strings end here too: part them
                part = len(self.goes)
                self.goes.append(dict(self.goes[suffix]))
                self.first_end.append(self.first_end[suffix])
                longest.append(longest[state] + 1)
                link += [part, link[suffix]]
                link[suffix] = part
                while state >= 0 and self.goes[state].get(symbol) == suffix:
                    self.goes[state][symbol] = part
                    state = link[state]
            else:
                link.append(suffix)
            last = new


def factors(symbols: Sequence[int]) -> list[Run]:
    """Lempel-Ziv factors (start, length, earlier start; -1 for a symbol that is new). A factor may overlap its earlier place."""
    automaton = Automaton(symbols)
    goes, first_end = automaton.goes, automaton.first_end
    found, start, n = [], 0, len(symbols)
    while start < n:
        state, length = 0, 0
        while start + length < n:
            further = goes[state][symbols[start + length]]
            if first_end[further] - length >= start:
                break
            state, length = further, length + 1
        found.append((start, max(1, length), first_end[state] - length + 1 if length else -1))
        start += max(1, length)
    return found


def prefix_matches(text: Sequence[int], stop: int) -> list[int]:
    """For each place before ``stop``: how far the text from there on agrees with the text's own start."""
    n = len(text)
    found = [0] * min(stop, n)
    if found:
        found[0] = n
    left = right = 0
    for at in range(1, len(found)):
        k = found[at - left] if at < right else 0
        if at + k >= right:
            k = max(0, right - at)
            while at + k < n and text[k] == text[at + k]:
                k += 1
            left, right = at, at + k
        found[at] = k
    return found


def touching(symbols: Sequence[int], low: int, start: int, end: int, exponent: int) -> set[Run]:
    """Repetitions (start, length, period) in symbols[low:end] that reach or touch ``start``, of ``exponent`` periods or more."""
    v, t = symbols[start:end], symbols[low:start]
    back = t[::-1]
    most = (end - low) // exponent
    found = set()
    if v:  # the period's first word stands at start
        forward = prefix_matches(v, most + 1)
        backward = prefix_matches([*back, -1, *v[:most][::-1], *back], len(back) + 1 + most)
        top = min(most, len(v))
        for p in range(1, top + 1):
            ahead = forward[p] if p < len(forward) else 0
            behind = backward[len(back) + 1 + top - p] if back else 0
            if ahead + behind >= (exponent - 1) * p:
                found.add((start - behind, p + ahead + behind, p))
    if t:  # the period's last word stands before start
        top = min(most, len(t))
        forward = prefix_matches([*v, -1, *t[len(t) - top :], *v], len(v) + 1 + top)
        backward = prefix_matches(back, top + 1)
        for p in range(1, top + 1):
            ahead = forward[len(v) + 1 + top - p] if v else 0
            behind = backward[p] if p < len(backward) else 0
            if ahead + behind >= (exponent - 1) * p:
                found.add((start - p - behind, p + ahead + behind, p))
    return found


def all_runs(symbols: Sequence[int], exponent: int = EXPONENT, least: int = LEAST) -> list[Run]:
    """All runs (start, length, period) of a sequence of numbers from 0 on, by start, then period; exponent is 2 or more."""
    symbols, n = list(symbols), len(symbols)
    found: dict[int, dict[int, int]] = {}  # by start and length the least period; a multiple of it has the same stretch
    previous = 0
    for start, length, earlier in [*factors(symbols), (n, 0, -1)]:
        for at, size, p in touching(symbols, max(0, start - 2 * previous - length), start, start + length, exponent):
            after = at + size
            grows = (at and symbols[at - 1] == symbols[at - 1 + p]) or (after < n and symbols[after] == symbols[after - p])
            if size >= least and not grows:  # what grows ends in a later factor
                of = found.setdefault(at, {})
                of[size] = min(p, of.get(size, p))
        if earlier >= 0:
            for at in range(earlier + 1, earlier + length - 1):  # in order, as an overlapping factor copies its own copies
                for size, p in found.get(at, {}).items():
                    if at + size < earlier + length:
                        found.setdefault(at + start - earlier, {})[size] = p
        previous = length
    return sorted((at, size, p) for at, of in found.items() for size, p in of.items())


def least_returns(exponent: int, least: int) -> int:
    """How often, at least, any three words in a row of a run occur.

    A run of period p > 1 has at least (exponent - 1) p places for three words in a row, so each of the p that differ comes that many
    times less one; a run of period 1 has max(exponent, least) - 2 such places, all alike.
    """
    return min(exponent - 1, max(exponent, least) - 2)


def stretches(symbols: np.ndarray, exponent: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches, apart from each other, outside which no run can be and over whose ends none can reach."""
    returns = least_returns(exponent, least)
    if len(symbols) < max(exponent, least):
        return
    if returns < 2:
        yield 0, len(symbols)
        return
    _, couples = np.unique(symbols[:-1] * (symbols.max() + 1) + symbols[1:], return_inverse=True)
    triples = couples[:-1] * (symbols.max() + 1) + symbols[2:]
    _, kind, counts = np.unique(triples, return_inverse=True, return_counts=True)
    often = np.concatenate([[0], (counts[kind] >= returns).view(np.int8), [0]])
    turns = np.flatnonzero(np.diff(often))
    for first, after in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        if after + 2 - first >= max(exponent, least):
            yield first, after + 2


def runs_of(found: Sequence[bytes], exponent: int = EXPONENT, least: int = LEAST) -> list[Run]:
    """All runs (start, length, period) of a sequence of words, by start, then period."""
    number: dict[bytes, int] = {}
    symbols = np.array([number.setdefault(w, len(number)) for w in found], dtype=np.int64)
    runs = []
    for start, end in stretches(symbols, exponent, least):
        runs += [(start + at, size, p) for at, size, p in all_runs(symbols[start:end].tolist(), exponent, least)]
    return sorted(runs)


def collapsed(found: Sequence[bytes], runs: Sequence[Run]) -> list[bytes]:
    """The words without those that any run has beyond its first period."""
    if not runs:
        return list(found)
    stays = np.ones(len(found), bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return [found[i] for i in np.flatnonzero(stays).tolist()]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _searched(text: str | None, exponent: int, least: int) -> tuple[int, list[Run], str | None]:
    """Number of words, runs, and the words without repeats, joined by spaces."""
    own = text.encode("utf-8", "surrogatepass").split() if text else []
    runs = runs_of(own, exponent, least)
    return len(own), runs, None if text is None else b" ".join(collapsed(own, runs)).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """The columns ``keep`` of each row, n_words, runs (by start, then period), and collapsed: the text's words without their repeats.

    Words are parted by ASCII white space and compared as they stand. A null text has no words, no runs and a null collapsed text; an empty or
    blank one an empty collapsed text. The whole text is read, however long, and each text on its own, so that no
    rows meet and repeated rows have equal results. Other columns are not looked at; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_searched(t.as_py(), exponent, least) for t in batch.column(len(keep))]
            runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in f[1]] for f in found], pa.list_(_RUN))
            own = [batch.column(i) for i in range(len(keep))]
            columns = [*own, pa.array([f[0] for f in found], pa.int64()), runs, pa.array([f[2] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_words", "runs", "collapsed"])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`"))
    kept = "".join(f"`{c}` {rows.schema[i].dataType.simpleString()}, " for i, c in enumerate(keep))
    return rows.mapInArrow(run, f"{kept}n_words long, runs {RUNS}, collapsed string")


def collapse(docs: DataFrame, text: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """docs with the repeats of each run cut from the text; all other columns stay as they are.

    Texts without a run stay byte for byte, in others words are joined by one space. Null texts stay null, an empty table stays empty.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(at)]
            found = [_searched(t, exponent, least) for t in texts]
            new = [f[2] if f[1] else t for t, f in zip(texts, found, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def _made_periodic(doc_id: Column, text: Column) -> Column:
    """The query's texts: of one document in ten the words from a on are those of one period, again and again."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def again(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        at = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(w, i.cast("int"))), " "))

    made = F.get(F.transform(F.array(words(text)), again), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(made, text)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))
    longest = F.array_min(order)
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        longest["start"].alias("start"),
        (-longest["n"]).alias("length"),
        longest["period"].alias("period"),
        F.floor(-1000 * longest["n"] / longest["period"]).alias("exponent_milli"),
        digest(F.array_join(lines, "")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
