"""Secret scans, in native expressions only.

Three patterns give the base spans.  The entropy scan adds more: in each run
of token characters a window slides along, its symbol counts are kept up to
date by the symbol that enters and the one that leaves, and the window's
Shannon entropy is compared with the threshold of its part's character class.
What an allow pattern matches cuts a run into parts, so windows that overlap it
give no entropy span; base spans are never suppressed.

Positions are running sums made in blocks, and a text is masked block by block:
no step copies a whole text or all its spans once for each span.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind: (pattern, group that is measured, least length of that group)
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
KINDS = (*BASE, "entropy")
#: Cheap forms that hold wherever a span can be.
HINTS = {"assign": r"""(?i:word|passwd|secret|token|key)["']?\x20*[:=]""", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: Equal to the pattern after short matches are dropped, as such matches are whole runs.
LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: character class: (its runs, bits per symbol from which a window counts); the first that fits holds
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("letters", r"^[A-Za-z]+$", 4.0), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.7))
ALLOWED = (
    r"(?i)example|sample|placeholder|changeme|dummy|your[_-]",
    r"(?i)0123456789|abcdefghij|qwertyuiop|deadbeef",
    r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
    r"(?<same>.)\k<same>{7,}",
)
MASK = "[SECRET]"
#: Numbers that are summed up in one go, and code points of a text that are masked in one go.
BLOCK, CHARS = 256, 4_096

SPANS = "array<struct<start:int,kind:int,end:int>>"


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(values: Column, merge) -> Column:
    """For each place of an array of integers, 0 merged with all values before it.

    Blocks are gone through by themselves, then their totals: n values cost
    n * BLOCK / 2 + (n / BLOCK)^2 / 2 copies of a number.
    """
    zero = F.struct(F.array().cast("array<int>").alias("seen"), F.lit(0).alias("all"))
    step = lambda total: lambda acc, x: F.struct(F.concat(acc["seen"], F.array(acc["all"])).alias("seen"), merge(acc["all"], total(x)).cast("int").alias("all"))

    def parts(v):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), zero, step(lambda x: x)))
        return bound(blocks, lambda bs: F.flatten(F.zip_with(bs, F.aggregate(bs, zero, step(lambda b: b["all"]), lambda acc: acc["seen"]), lambda b, t: F.transform(b["seen"], lambda x: merge(t, x).cast("int")))))

    return bound(values, lambda v: F.when(F.size(v) > 0, parts(v)).otherwise(F.array().cast("array<int>")))


def runs(text: Column, pattern: str, group: int) -> Column:
    """Matches of a pattern, in order: what stands before each, the match, and its group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.transform(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole).alias("value")), lambda x: F.struct(x["gap"].alias("text"), F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["whole"]), F.lit(0)).alias("whole"), x["value"].alias("value")))


def placed(found: Column, spans) -> Column:
    """Spans of all runs; `spans(run, start)` gives an array of them for a run whose gap ends at `start`."""
    return bound(found, lambda f: F.flatten(F.zip_with(f, before(F.transform(f, lambda x: x["gap"] + x["whole"]), lambda a, b: a + b), lambda x, at: spans(x, at + x["gap"]))))


def span(start: Column, kind: int, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))


def base(text: Column, kind: str) -> Column:
    """The spans of one base kind: leftmost matches that don't overlap, without short ones."""
    pattern, group, least = BASE[kind]
    at, pattern = KINDS.index(kind), LONG.get(kind, pattern)
    short = F.array().cast(SPANS)
    made = placed(runs(text, pattern, group), lambda x, start: F.when(F.length(x["value"]) >= least, F.array(span(start, at, start + x["whole"]))).otherwise(short))
    return F.when(text.rlike(HINTS[kind]), made).otherwise(short)


def hot_range(run: Column, bits: Column, window: int) -> Column:
    """struct(first, last): the least range of a run that holds every window of at least `bits` bits per symbol; null without one."""
    plogp = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    get = lambda a, i: F.get(a, i - 1)

    def over(symbols):
        kinds = F.array_distinct(symbols)
        places = F.transform(symbols, lambda s: F.array_position(kinds, s).cast("int"))
        zero = F.struct(F.transform(kinds, lambda _: F.lit(0)).alias("counts"), F.lit(0.0).cast("double").alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), F.lit(0).alias("i"))

        def slide(places):
            def step(acc, enters):
                i = acc["i"] + 1
                leaves = F.coalesce(get(places, i - window), F.lit(0))
                k = get(acc["counts"], enters)
                m = get(acc["counts"], leaves) + F.when(leaves == enters, 1).otherwise(0)
                total = acc["sum"] + F.get(plogp, k + 1) - F.get(plogp, k) - F.when(leaves > 0, F.get(plogp, m) - F.get(plogp, m - 1)).otherwise(0.0)
                counts = F.transform(acc["counts"], lambda c, j: c + F.when(j + 1 == enters, 1).otherwise(0) - F.when(j + 1 == leaves, 1).otherwise(0))
                hot = (i >= window) & (math.log2(window) - total / window >= bits)
                return F.struct(counts.alias("counts"), total.alias("sum"), F.when(hot & acc["first"].isNull(), i - window).otherwise(acc["first"]).alias("first"), F.when(hot, i).otherwise(acc["last"]).alias("last"), i.alias("i"))

            return F.aggregate(places, zero, step, lambda acc: F.when(acc["first"].isNotNull(), F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))

        return F.get(F.transform(F.array(places), slide), F.lit(0))

    symbols = F.filter(F.split(run, ""), lambda s: s != "")
    return F.get(F.transform(F.array(symbols), over), F.lit(0))


def entropy(text: Column, window: int, classes, allowed) -> Column:
    """The spans of parts of runs with a window of high entropy."""
    none = F.array().cast(SPANS)
    known = "|".join(f"(?:{p})" for p in allowed) or r"(?!)"

    def part(value, start):
        bits, hexes = F.lit(99.0), F.lit(False)
        for name, pattern, least in reversed(classes):
            bits = F.when(value.rlike(pattern), F.lit(least)).otherwise(bits)
            hexes = value.rlike(pattern) if name == "hex" else hexes
        found = hot_range(F.when(hexes, F.lower(value)).otherwise(value), bits, window)
        out = F.transform(F.array(found), lambda r: span(start + r["first"], KINDS.index("entropy"), start + r["last"]))
        return F.when(F.length(value) >= window, F.filter(out, lambda s: s["start"].isNotNull())).otherwise(none)

    def made(x, start):
        cut = placed(runs(x["value"], known, 0), lambda y, end: part(y["text"], start + end - y["gap"]))
        return F.when(x["value"].isNull(), none).when(x["value"].rlike(known), cut).otherwise(part(x["value"], start))

    return F.when(text.rlike(CANDIDATE), placed(runs(text, CANDIDATE, 0), made)).otherwise(none)


def find(docs: DataFrame, window: int = WINDOW, classes=CLASSES, allowed=ALLOWED, text_column: str = "text", out: str = "found") -> DataFrame:
    """The rows with one more column `out`: array of (start, kind, end), by start and kind.

    start and end count code points, end exclusive; kind is a position in
    KINDS.  A null or empty text has no spans.  Rows, repeated ones too, and
    all other columns stay; an empty table gives no rows.
    """
    if out in docs.columns:
        raise ValueError(f"the rows already have a column {out}")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    every = bound(text, lambda t: F.concat(*[base(t, kind) for kind in BASE], entropy(t, window, classes, allowed)))
    return docs.withColumn(out, bound(every, lambda e: F.when(F.size(e) > 0, F.array_sort(e)).otherwise(e)))


def named(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy for each row."""
    found = find(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), text_column="text", **options).select("doc_id", "found")
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base_only = F.filter("found", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *[of(k) for k in BASE], F.sha2(named(base_only).cast("binary"), 256).alias("base_sha256"), named(F.col("found")).alias("spans"), of("entropy"))


def merged(spans: Column) -> Column:
    """Disjoint (start, end) that cover an array of spans, which are ordered by their start."""

    def joined(s, reach):
        heads = F.filter(F.zip_with(s, reach, lambda x, r: F.struct(x["start"].alias("start"), r.alias("reach"))), lambda x: x["start"] >= x["reach"])
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        return bound(heads, lambda hs: F.transform(hs, lambda h, i: F.struct(h["start"].alias("start"), F.coalesce(F.get(hs, i + 1)["reach"], last).alias("end"))))

    return bound(spans, lambda s: bound(before(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), lambda reach: joined(s, reach)))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each of the disjoint spans replaced; at most 1,000 blocks, or blocks of CHARS, are masked one by one."""
    size = F.greatest(F.lit(CHARS), F.ceil(F.length(text) / 1000).cast("int"))

    def block(value, low, own):
        start = lambda i: F.when(i > 0, F.get(own, i - 1)["end"]).otherwise(low)
        parts = F.transform(own, lambda s, i: F.concat(F.substring(value, start(i) - low + 1, F.greatest(s["start"] - start(i), F.lit(0))), F.when(s["start"] >= low, F.lit(mask)).otherwise("")))
        last = F.get(own, F.size(own) - 1)["end"]
        return F.when(F.size(own) == 0, value).otherwise(F.concat(F.array_join(parts, ""), F.when(last < low + F.length(value), F.substring(value, last - low + 1, F.length(value))).otherwise("")))

    def whole(sz, blocks, m):
        return F.array_join(F.transform(blocks, lambda value, i: bound(F.filter(m, lambda s: (s["end"] > i * sz) & (s["start"] < (i + 1) * sz)), lambda own: block(value, i * sz, own))), "")

    cut = F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}")), F.lit(0))
    return bound(size, lambda sz: bound(cut, lambda blocks: bound(merged(spans), lambda m: whole(sz, blocks, m))))


def redact(docs: DataFrame, text_column: str = "text", mask: str = MASK, **options) -> DataFrame:
    """The rows with every span in the text replaced by `mask`; spans that overlap are replaced together.

    A null text stays null; rows, repeated ones too, and all other columns
    stay; an empty table gives no rows.
    """
    out = "__spans"
    while out in docs.columns:
        out += "_"
    spans = find(docs, text_column=text_column, out=out, **options)
    text = F.col(text_column).cast("string")
    return spans.withColumn(text_column, F.when(F.size(out) > 0, masked(text, F.col(out), mask)).otherwise(F.col(text_column))).drop(out)
