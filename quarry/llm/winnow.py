"""Document fingerprints by winnowing, in native expressions only.

A text becomes lower-cased words; each run of K words has a polynomial hash
modulo a prime, the value that a rolling hash takes there; each window of W
such hashes gives its least one, the rightmost of equal ones, with its
position.  Any run of W + K - 1 words that two texts share leaves a common
fingerprint.  The hashes of all runs, and the minima of all windows, come from
adding up neighbours in doubling steps: whole arrays at a time, without a loop
over the words in a window.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._util import shuffle_partitions

K = 5
W = 8
PRIME = (1 << 31) - 1
BASE = 1_103_515_245
LOW = (1 << 32) - 1
WORD = r"[\p{L}\p{N}]+"
FIRST = -(1 << 63)
#: Edges of buckets that a row is compared with in one go.
STRIDE = 256


def steps(n: int) -> list[tuple[int, int]]:
    """(length so far, length added) of the doubling that reaches n from 1."""
    out, have = [], 1
    while have < n:
        out.append((have, min(have, n - have)))
        have += out[-1][1]
    return out


def beside(left: Column, right: Column, shift: int, merge) -> Column:
    """merge(left[i], right[i + shift]) wherever both are."""
    n = F.greatest(F.size(right) - shift, F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(shift + 1), n), merge)


def joined(power: int):
    """The hash of a run and the run after it, from the hashes of both."""
    return lambda a, b: (a * power + b) % PRIME


def fingerprints(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """The rows with one more column `out`: array<long> of hash * 2^32 + (2^32 - 1 - position), by position.

    A text of fewer than k words has one run, a text of fewer than w runs one
    window; a text with characters but no letters or digits is one word; an
    empty or null text has no fingerprints.
    """
    own = [c for c in df.columns]
    value = F.coalesce(F.col(text), F.lit(""))
    df = df.select("*", F.regexp_extract_all(F.lower(value), F.lit(WORD), F.lit(0)).alias("__words"))
    words = F.when((F.size("__words") == 0) & (F.trim(value) != ""), F.array(F.trim(value))).otherwise(F.col("__words"))
    df = df.select(*own, words.alias("__words"))
    df = df.select(*own, F.transform("__words", lambda x: F.xxhash64(x).bitwiseAND(PRIME) % PRIME).alias("__h1"))
    # __h1 holds the words' hashes; __h<n> those of runs of n words.
    for have, add in steps(k):
        power = pow(BASE, add, PRIME)
        keep = [f"__h{n}" for n in {1, have, *(a for h, a in steps(k) if h > have)} if n <= have]
        df = df.select(*own, *keep, beside(F.col(f"__h{have}"), F.col(f"__h{add}"), have, joined(power)).alias(f"__h{have + add}"))
    short = F.aggregate("__h1", F.lit(0).cast("long"), lambda a, x: (a * BASE + x) % PRIME)
    grams = F.when(F.size("__h1") >= k, F.col(f"__h{k}")).when(F.size("__h1") > 0, F.array(short)).otherwise(F.array().cast("array<long>"))
    df = df.select(*own, grams.alias("__g"))
    df = df.select(*own, F.transform("__g", lambda x, i: F.shiftleft(x, 32).bitwiseOR(F.lit(LOW) - i)).alias("__m1"))
    for have, add in steps(w):
        keep = ["__m1", *([f"__m{have}"] if have > 1 else [])]
        shift = add  # windows of `have` that overlap make one of have + add
        df = df.select(*own, *keep, beside(F.col(f"__m{have}"), F.col(f"__m{have}"), shift, lambda a, b: F.least(a, b)).alias(f"__m{have + add}"))
    picked = F.when(F.size("__m1") >= w, F.array_distinct(f"__m{w}")).when(F.size("__m1") > 0, F.array(F.array_min("__m1"))).otherwise(F.array().cast("array<long>"))
    return df.select(*own, picked.alias(out))


def shown(marks: str) -> Column:
    """hash:position of each fingerprint, comma-joined; hashes are hexadecimal."""
    return F.array_join(F.transform(marks, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 32))), F.lit(":"), (F.lit(LOW) - x.bitwiseAND(LOW)).cast("string"))), ",")


def hashes(marks: str) -> Column:
    return F.array_distinct(F.transform(marks, lambda x: F.shiftright(x, 32)))


def likeness(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """One more column: shared hashes by all hashes of two arrays of distinct hashes; 1 if both are empty."""
    own = df.columns
    df = df.select("*", F.size(F.array_intersect(left, right)).alias("__both"))
    every = F.size(left) + F.size(right) - F.col("__both")
    return df.select(*own, F.when(every > 0, F.col("__both") / every).otherwise(1.0).alias(out))


def edges_of(ids: DataFrame, buckets: int) -> list[tuple[int, int]]:
    """(id, hash) at which buckets begin: approximate quantiles of the ids; an id that several of them name is cut by the hash of the text."""
    cuts = ids.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)], max(10_000, 20 * buckets)).alias("cuts")).first()["cuts"] or []
    times = Counter(cuts)
    return sorted((c, FIRST + j * (1 << 64) // n) for c, n in times.items() for j in range(n))


def bucket_of(edges: list[tuple[int, int]], key: Column) -> Column:
    """How many edges are at or below a (id, hash)."""
    listed = lambda some: F.array(*[F.struct(F.lit(a).cast("long").alias("id"), F.lit(b).cast("long").alias("h")) for a, b in some])
    if not edges:
        return F.lit(0)
    upto = lambda some: F.size(F.filter(some, lambda c: c <= key))
    first = upto(listed(edges[::STRIDE]))
    return F.when(first == 0, 0).otherwise((first - 1) * STRIDE + upto(F.slice(listed(edges), (first - 1) * STRIDE + 1, F.lit(STRIDE))))


def beside_next(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, ghost, doc_id, text, h: each bucket holds a range of (id, hash of the text), and after it, as a ghost, the row that follows the range.

    The first (id, hash) of the buckets, one each, are all that the driver
    reads, and all that is broadcast.
    """
    keyed = docs.select("*", F.coalesce("doc_id", F.lit(FIRST)).alias("id"), F.xxhash64("text").alias("h"))
    edges = edges_of(docs.select(F.coalesce("doc_id", F.lit(FIRST)).alias("id")), buckets)
    placed = keyed.select("*", bucket_of(edges, F.struct("id", "h")).alias("bucket"))
    firsts = sorted((r["bucket"], r["x"]["id"], r["x"]["h"]) for r in placed.groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("x")).collect())
    told = [F.struct(F.lit(firsts[k - 1][0]).cast("int").alias("to"), F.lit(i).cast("long").alias("id"), F.lit(h).cast("long").alias("first")) for k, (_, i, h) in enumerate(firsts)]
    listed = F.array(*told) if told else F.array().cast("array<struct<to:int,id:bigint,first:bigint>>")
    after = docs.sparkSession.range(1).select(F.explode(listed).alias("x")).select("x.*")
    ghosts = keyed.join(F.broadcast(after), "id").where(F.col("h") == F.col("first")).groupBy("to", "id", "h").agg(F.min(F.struct("text", "doc_id")).alias("x"))
    own = placed.select(F.col("bucket").cast("int").alias("bucket"), F.lit(False).alias("ghost"), "doc_id", "text", "h")
    return own.unionByName(ghosts.select(F.col("to").alias("bucket"), F.lit(True).alias("ghost"), F.col("x.doc_id").alias("doc_id"), F.col("x.text").alias("text"), "h"))


def compare(docs: DataFrame, k: int = K, w: int = W, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The edited text has its last half replaced by as many first characters of
    the next row's text, or all of them; rows are in ascending order of doc_id,
    null first, rows of one id by a hash of their text, then by the text; the
    first row follows the last.  A null text is empty; repeated rows stay; an
    empty table gives no rows; other columns are not read.  Rows of one id go
    to several tasks if there are many, but rows alike in id and text to one.
    """
    parts = shuffle_partitions(docs.sparkSession)
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    dealt = beside_next(docs, 4 * parts).repartition(parts, "bucket")
    marked = fingerprints(dealt, "text", "marks", k, w)
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "h", "text")
    paired = marked.select("*", F.lead("text").over(order).alias("next"), F.lead("marks").over(order).alias("next_marks")).where(~F.col("ghost"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half))
    paired = paired.select("doc_id", F.length("text").cast("long").alias("n_chars"), "marks", "next_marks", edited.alias("edited"))
    paired = fingerprints(paired, "edited", "edited_marks", k, w)
    paired = paired.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "marks", "edited_marks", hashes("marks").alias("a"), hashes("edited_marks").alias("b"), hashes("next_marks").alias("c"))
    paired = likeness(likeness(paired, "a", "b", "near_edited"), "a", "c", "near_next")
    return paired.select("doc_id", "n_chars", "edited_sha256", shown("marks").alias("fingerprint"), shown("edited_marks").alias("edited_fingerprint"), "near_edited", "near_next")
