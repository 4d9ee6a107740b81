"""Packing: documents are put end to end and cut into windows of equal length.

Pass one encodes each document once and keeps, beside its ids, the number of
ids before it in its partition.  The partitions' totals, one number each, are
summed on the driver; with them every document knows its global offset.  Pass
two cuts each document at the multiples of the window: nothing is shuffled or
sorted, and no step holds more than a batch of documents.

What is left after the last whole window is cut into windows whose lengths are
powers of two, which need no padding either.
"""

from __future__ import annotations

import bisect
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._util import array_slices, checkpoint, in_process, tidy
from quarry.llm.encoding import byte_level, id_dtype

#: Bytes of text that are encoded at once, and of ids that are given to Spark at once.
SLICE, GIVEN = 32_000_000, 500_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tail_edges(total: int, window: int) -> list[int]:
    """Where the windows after the last whole one begin, and the total."""
    edge, edges = total - total % window, []
    for bit in range(window.bit_length() - 1, -1, -1):
        if total % window >> bit & 1:
            edges.append(edge)
            edge += 1 << bit
    return [*edges, total]


def cut(begin: int, end: int, window: int, tail: list[int]) -> list[tuple[int, int, int, int]]:
    """(from, to, sequence, offset in it) of the pieces of the ids from `begin` to `end`."""
    out, whole = [], tail[0] // window
    while begin < end:
        if begin < tail[0]:
            number, first = begin // window, begin // window * window
            last = first + window
        else:
            i = bisect.bisect_right(tail, begin) - 1
            number, first, last = whole + i, tail[i], tail[i + 1]
        out.append((begin, min(end, last), number, begin - first))
        begin = last
    return out


def encoded(docs: DataFrame, path: str, separator: int, special: bool, id_column: str, text_column: str) -> DataFrame:
    """doc_id, part, before (ids before it in its part), ids (with the separator), n; checkpointed."""
    own = ("byte_level", path, special)

    def encode(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        encoder = in_process(own, lambda: byte_level(path, special))
        width = np.dtype(encoder.dtype).itemsize
        end, nothing = (pa.scalar(x, pa.large_binary()) for x in (np.array([separator], encoder.dtype).tobytes(), b""))
        for batch in batches:
            for first, texts in array_slices(batch.column(1), SLICE):
                ids = pc.binary_join_element_wise(encoder.encode(texts), end, nothing)
                n = pc.binary_length(ids).to_numpy() // width
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([part] * len(texts), pa.int32()), pa.array(starts), ids.cast(pa.binary()), pa.array(n)], ["doc_id", "part", "before", "ids", "n"])
                for at, some in array_slices(ids, GIVEN):
                    yield rows.slice(at, len(some))

    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return checkpoint(read.mapInArrow(tidy(encode, own), "doc_id long, part int, before long, ids binary, n long"))


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, separator: int = 1, special: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece of a document in a sequence.

    `tokenizer` is the path of a file of the tokenizers library, on every
    executor.  The string of a special token in a text is that token, as the
    library has it; with `special` false it is ordinary text.  A null or empty
    text is the separator alone; a null id stays null; repeated rows are packed each for itself; an empty table gives no
    rows; other columns are not read.  The order of documents is that of the
    input's partitions.
    """
    if window < 1 or window & window - 1:
        raise ValueError("the window must be a power of two")
    done = encoded(docs, tokenizer, separator, special, id_column, text_column)
    totals = {r["part"]: r["n"] for r in done.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    parts = sorted(totals)
    offsets = dict(zip(parts, itertools.accumulate([0, *[totals[p] for p in parts]])))
    total = sum(totals.values())
    tail = tail_edges(total, window)

    def pieces(batches):
        for batch in batches:
            cols, crcs = [[] for _ in range(6)], []
            for doc, part, before, ids, n in zip(*[batch.column(i).to_pylist() for i in range(3)], (x.as_buffer() for x in batch.column(3)), batch.column(4).to_pylist()):
                dtype = id_dtype(1 << 16 if ids.size == 2 * n else 1 << 32)
                ids, base = np.frombuffer(ids, dtype).astype("<u4"), offsets[part] + before
                for a, b, number, offset in cut(base, base + n, window, tail):
                    crcs.append(zlib.crc32(ids[a - base : b - base]))
                    for col, x in zip(cols, (doc, a - base, b - a, n, number, offset)):
                        col.append(x)
            doc, start, length, n, number, offset = [pa.array(x, pa.int64()) for x in cols]
            yield pa.RecordBatch.from_arrays([doc, start, length, pa.array(crcs, pa.int64()), n, number, offset], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return done.mapInArrow(tidy(pieces), PIECES)
