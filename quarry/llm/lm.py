"""Stupid-backoff scores, computed relationally.

Documents become chunks of tokens.  For one order after the other, each chunk
sends its distinct n-grams, hashed, with their counts to the buckets of a hash
range; a bucket adds them up to its part of the n-gram count table and joins
the table with what each chunk asked for.  At last a chunk joins the answers
with its tokens and sums each document.  A frequent n-gram is one row per
chunk, so no key is hot, and what is gathered grows with the corpus.  Rows are
packed arrays, one for each chunk, order and bucket; the n-grams sent for one
order are deleted before those of the next are.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._util import checkpoint, shuffle_partitions, slices, tidy

CHUNK, SLICE = 6_000_000, 500_000
BUCKET_ROWS = 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
SEED = 7


def planes(values: np.ndarray) -> bytes:
    """Compressed byte planes: the high bytes of small numbers cost little."""
    raw = values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unplanes(data: bytes, dtype: str) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    raw = pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(size, n).T.copy().view(dtype).reshape(-1)


def tokens(text: str) -> list[str]:
    """Lower-cased words between white space."""
    return text.lower().split()


class Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def chunks(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """chunk, ids, sizes (tokens of each document), vocabulary (hash of each word), tokens, n."""

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def packed(ids, sizes, vocabulary, found):
            hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), SEED) for w in vocabulary), np.uint64, len(vocabulary))
            every = np.concatenate(found).astype(np.uint32) if found else np.zeros(0, np.uint32)
            cols = [pa.array([x]) for x in (number, planes(np.array(sizes, np.int64)), planes(hashes), planes(every), len(every))]
            return pa.RecordBatch.from_arrays([cols[0], pa.array([ids], pa.list_(pa.int64())), *cols[1:]], ["chunk", "ids", "sizes", "vocabulary", "tokens", "n"])

        ids, sizes, vocabulary, found, held = [], [], Numbers(), [], 0
        for batch in batches:
            for first, texts in slices(batch.column(1), SLICE):
                for doc, text in zip(batch.column(0).slice(first, len(texts)).to_pylist(), texts):
                    own = tokens(text)
                    ids.append(doc)
                    sizes.append(len(own))
                    found.append(np.fromiter(map(vocabulary.__getitem__, own), np.uint32, len(own)))
                    held += len(text) + 100
                    if held >= CHUNK:
                        yield packed(ids, sizes, vocabulary, found)
                        number += 1
                        ids, sizes, vocabulary, found, held = [], [], Numbers(), [], 0
        if ids:
            yield packed(ids, sizes, vocabulary, found)

    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return read.mapInArrow(tidy(run), "chunk long, ids array<long>, sizes binary, vocabulary binary, tokens binary, n long")


def ngrams(vocabulary: np.ndarray, found: np.ndarray, sizes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to order: (positions where an n-gram ends, its hash)."""
    place = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    one = vocabulary[found]
    h, out = one, [(np.arange(len(found)), one)]
    for n in range(2, order + 1):
        h = h[:-1] * MIX + one[n - 1 :]
        ends = np.arange(n - 1, len(found))
        fit = place[ends] >= n - 1
        out.append((ends[fit], h[fit]))
    return out


def distinct(h: np.ndarray, order: int):
    """Sorted distinct finished hashes, the place of each n-gram among them, and their counts."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9 + 2 * order)
    return np.unique(h ^ (h >> np.uint64(29)), return_inverse=True, return_counts=True)


def score(docs: DataFrame, order: int = 2, backoff: float = 0.4, least: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_score (sum of natural logarithms), score (its mean per token, null without tokens), backoffs (steps taken).

    Counts cover all documents, the scored one too.  An n-gram of order 2 or
    more that is counted under `least` times backs off to the next shorter one
    times `backoff`; a single word always has its count.  A null or empty text
    has no tokens and log_score 0; null ids and repeated rows stay, and count;
    an empty table gives no rows; other columns are not read.
    """
    held = checkpoint(chunks(docs, id_column, text_column))
    total = held.agg(F.sum("n")).first()[0] or 0
    spark = docs.sparkSession
    bits = max(2 * shuffle_partitions(spark), total // BUCKET_ROWS).bit_length()

    def ask(n):
        def run(batches):
            for batch in batches:
                for chunk, sizes, vocabulary, found in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                    cols = [[] for _ in range(5)]
                    _, h = ngrams(unplanes(vocabulary, "u8"), unplanes(found, "u4"), unplanes(sizes, "i8"), n)[-1]
                    value, _, times = distinct(h, n)
                    bucket = (value >> np.uint64(64 - bits)).astype(np.int64)
                    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
                    for a, b in zip(edges, [*edges[1:], len(value)]):
                        for col, x in zip(cols, (int(bucket[a]), n, chunk, planes(np.diff(value[a:b], prepend=np.uint64(0))), planes(times[a:b].astype(np.uint32)))):
                            col.append(x)
                    types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["bucket", "order", "chunk", "grams", "times"])

        return run

    def answer(table):
        out = [[] for _ in range(4)]
        orders = table.column("order").to_numpy()
        for n in np.unique(orders):
            some = table.filter(pa.array(orders == n))
            grams = [np.cumsum(unplanes(g, "u8"), dtype=np.uint64) for g in some.column("grams").to_pylist()]
            times = np.concatenate([unplanes(t, "u4") for t in some.column("times").to_pylist()])
            value, place = np.unique(np.concatenate(grams), return_inverse=True)
            count = np.bincount(place, times, len(value)).astype(np.int64)[place]
            at = 0
            for chunk, g in zip(some.column("chunk").to_pylist(), grams):
                for col, x in zip(out, (chunk, int(n), some.column("bucket")[0].as_py(), planes(count[at : at + len(g)]))):
                    col.append(x)
                at += len(g)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=["chunk", "order", "bucket", "counts"])

    def add(left, right):
        ids, n_tokens, sums, steps = [], [], [], []
        table = right.sort_by([("order", "ascending"), ("bucket", "ascending")])
        orders, counts = table.column("order").to_numpy(), table.column("counts").to_pylist()
        for own, sizes, vocabulary, found in zip(*[left.column(c).to_pylist() for c in ("ids", "sizes", "vocabulary", "tokens")]):
            sizes = unplanes(sizes, "i8")
            levels = ngrams(unplanes(vocabulary, "u8"), unplanes(found, "u4"), sizes, order)
            known = []  # the count of the n-gram that ends at each position, 0 where there is none
            for n, (ends, h) in enumerate(levels, 1):
                full = np.zeros(int(sizes.sum()), np.int64)
                if len(h):
                    full[ends] = np.concatenate([unplanes(c, "i8") for c, o in zip(counts, orders) if o == n])[distinct(h, n)[1]]
                known.append(full)
            logs = np.log(np.maximum(known[0], 1)) - np.log(max(total, 1))
            back = np.zeros(len(logs), np.int64)
            place = np.arange(len(logs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            for n in range(2, order + 1):
                seen = known[n - 1] >= least
                before = np.concatenate([[1], known[n - 2][:-1]])
                shorter = place >= n - 1
                logs = np.where(seen, np.log(np.maximum(known[n - 1], 1)) - np.log(np.maximum(before, 1)), np.where(shorter, logs + np.log(backoff), logs))
                back = np.where(seen, 0, np.where(shorter, back + 1, back))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            ids += own
            n_tokens += sizes.tolist()
            sums.append(np.bincount(owner, logs, len(sizes)))
            steps.append(np.bincount(owner, back, len(sizes)).astype(np.int64))
        whole = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "log_score": whole(sums, float), "backoffs": whole(steps, np.int64)})

    counts = []
    for n in range(1, order + 1):
        asked = held.select("chunk", "sizes", "vocabulary", "tokens").mapInArrow(tidy(ask(n)), "bucket long, order int, chunk long, grams binary, times binary")
        counts.append(checkpoint(asked.groupBy("bucket").applyInArrow(answer, "chunk long, order int, bucket long, counts binary")))
    answers = functools.reduce(DataFrame.unionByName, counts)
    told = held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add, "doc_id long, n_tokens long, log_score double, backoffs long")
    return told.select("doc_id", "n_tokens", "log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")).alias("score"), "backoffs")
