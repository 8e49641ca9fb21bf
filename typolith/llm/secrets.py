"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Only built-in column functions.  ``scan`` returns, for each row, the spans found:
code point offsets, end exclusive, each with its kind.

* ``assign``, ``access``, ``hex``: leftmost non-overlapping matches of a pattern, then
  those whose value is too short are dropped.
* ``entropy``: a candidate is a run of 20 or more of ``[A-Za-z0-9+/_=-]``.  A window of
  20 characters slides over it; its symbol counts change by one character in and one
  out, and so does the sum of c*log2(c) that its Shannon entropy follows from.  A window
  counts if it has a digit and a letter and its entropy reaches the threshold of its
  class: hex digits only, or any.  Windows that touch a match of the allow-list don't
  count.  A candidate with a window that does is a span, unless it overlaps a span of
  another kind.

A null or empty text has no spans, a text of any length is scanned whole.  Rows are
independent, so repeated rows get equal results.  All other columns pass, whatever their
names; one named ``found`` is replaced by ``scan``, and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import packed

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALLOWED = "(?i)example|sample|placeholder|dummy|xxxx|0123456789|abcdefgh|deadbeef"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW, HEX_BITS, ANY_BITS = 20, 3.0, 3.6

SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def _placed(text: Column, pattern: str, rank: int, keep) -> Column:
    """Spans of the matches: what stands between them is what split() leaves."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), *( [F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value")] if keep else []))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.array(F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), end.cast("long").alias("end")))
        more = F.concat(acc["out"], span)
        return F.struct(end.cast("long").alias("at"), (F.when(keep(x), more).otherwise(acc["out"]) if keep else more).alias("out"))

    return F.aggregate(rows, empty, step, lambda acc: acc["out"])


def _high_entropy(s: Column) -> Column:
    """Whether a window of s reaches its class's threshold."""
    n_log_n = F.array(*[F.lit(0.0 if c < 2 else c * _log2(c)) for c in range(WINDOW + 2)])
    # one symbol enters and, once the window is full, one leaves
    start = F.struct(
        F.array_repeat(F.lit(0), len(SYMBOLS)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(0).alias("digits"),
        F.lit(0).alias("letters"),
        F.lit(0).alias("hexes"),
        F.lit(False).alias("found"),
    )

    def n(cond: Column) -> Column:
        return cond.cast("int")

    def step(acc: Column, i: Column) -> Column:
        inn = F.substring(s, i, 1)
        out = F.when(i > WINDOW, F.substring(s, i - WINDOW, 1)).otherwise("")
        ki, ko = F.instr(F.lit(SYMBOLS), inn), F.when(out == "", F.lit(0)).otherwise(F.instr(F.lit(SYMBOLS), out))
        # the count of the symbol that leaves is changed first
        co = F.when(ko > 0, F.get(acc["counts"], ko - 1)).otherwise(F.lit(0))
        ci = F.get(acc["counts"], ki - 1) - n(ki == ko)
        total = acc["sum"] + F.when(ko > 0, F.get(n_log_n, co - 1) - F.get(n_log_n, co)).otherwise(0.0) + F.get(n_log_n, ci + 1) - F.get(n_log_n, ci)
        digits = acc["digits"] + n(inn.between("0", "9")) - n((out != "") & out.between("0", "9"))
        letters = acc["letters"] + n(ki <= 52) - n((ko > 0) & (ko <= 52))
        hexes = acc["hexes"] + n(inn.rlike("[0-9a-fA-F]")) - n(out.rlike("[0-9a-fA-F]"))
        bits = F.lit(_log2(WINDOW)) - total / WINDOW
        hit = (i >= WINDOW) & (digits > 0) & (letters > 0) & (bits >= F.when(hexes == WINDOW, F.lit(HEX_BITS)).otherwise(F.lit(ANY_BITS)))
        counts = F.transform(acc["counts"], lambda c, k: c + n(k + 1 == ki) - n(k + 1 == ko))
        return F.struct(counts.alias("counts"), total.alias("sum"), digits.alias("digits"), letters.alias("letters"), hexes.alias("hexes"), (acc["found"] | hit).alias("found"))

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), start, step, lambda acc: acc["found"])


def _log2(c: int) -> float:
    import math

    return math.log2(c)


def _found(docs: DataFrame, text_col: str, *drop: str) -> DataFrame:
    """(row, text, found): the columns of docs but some, the text and its spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(SPAN)
    assign = F.when((F.instr(text, "=") > 0) | (F.instr(text, ":") > 0), _placed(text, ASSIGN, 0, lambda x: F.length(x["value"]) >= 6)).otherwise(none)
    access = F.when(F.instr(text, "AKIA") > 0, _placed(text, ACCESS, 1, None)).otherwise(none)
    hexes = F.when(text.rlike(HEX), _placed(text, HEX, 2, None)).otherwise(none)
    # long words are candidates by the thousand; a digit among the characters is needed first
    digit_near = text.rlike("(?=[A-Za-z0-9+/_=-]{20})[A-Za-z+/_=-]*[0-9]")
    runs = F.when(digit_near, _placed(text, CANDIDATE, 3, None)).otherwise(none)
    df = docs.select(packed(docs, *drop).alias("row"), F.col(text_col).alias("text"), F.concat(assign, access, hexes).alias("base"), runs.alias("runs"))

    def wanted(r: Column) -> Column:
        s = F.substring(F.col("text"), (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int"))
        free = ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
        parts = F.filter(F.split(s, ALLOWED, -1), lambda x: (F.length(x) >= WINDOW) & x.rlike("[0-9]") & x.rlike("[A-Za-z]"))
        return F.when(free, F.exists(parts, _high_entropy)).otherwise(F.lit(False))

    return df.select("row", "text", F.array_sort(F.concat("base", F.filter("runs", wanted))).alias("found"))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Append ``found``, the array of spans (start, rank in KINDS, end) by start and rank."""
    return _found(docs, text_col, "found").select("row.*", "found")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs, with a mark in place of each stretch that spans cover; a null text stays null."""
    text = F.col("text")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        apart = (x["start"] > acc["at"]) | (acc["at"] == 0)
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(apart, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    rebuilt = F.aggregate("found", state, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    clean = F.when(F.size("found") > 0, rebuilt).otherwise(text)
    return _found(docs, text_col).select(*[clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
