"""Groups of near copies by the Jaccard similarity of word shingles.

A text is the set of its hashed shingles.  The vantage-point tree of
`simhash` proposes: sets whose SimHash fingerprints differ in at most `radius`
bits meet in a star.  At similarity 0.8 sets differ in about ten bits, where no
vantage point parts fingerprints, so MinHash bands propose what lies beyond the
radius: texts that share a band meet in a star too.  Stars that share a text
meet in a candidate group, so no row is made for a pair.  Two texts at the
similarity 0.8 share none of the 40 bands of 5 minima with probability 1.3e-7,
less above it.  Every proposal is checked: a candidate group is flooded by
exact Jaccard similarity, and only what that reaches is a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._util import checkpoint, text_slices, tidy
from quarry.llm.simhash import majority, spread, stars

SEED = 42
SLICE = 300_000
BANDS = 40
ROWS = 5
MIX = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 32, (BANDS * ROWS, 2)).astype(np.uint32) | np.uint32(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Words are lower-cased in A-Z and cut at ASCII white space; a text of fewer
    words than a shingle is one shingle, one without words has none.
    """
    import xxhash

    known: dict[bytes, int] = {}
    out = []
    for text in texts:
        words = text.encode().lower().split()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, SEED)
        one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(size, len(one))
        h = np.full(max(len(one) - n + 1, 0) if n else 0, n, np.uint64)
        for i in range(n):
            h = h * MIX + one[i : len(one) - n + 1 + i]
        out.append(np.unique(mixed(h)))
    return out


def names(sets: list[np.ndarray]) -> np.ndarray:
    """One number for each set, the same for equal sets."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """The band keys of sets that aren't empty, one row each."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    h = np.concatenate(sets)
    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for a, b in FACTORS[band * ROWS : (band + 1) * ROWS]:
            key = mixed(key * MIX + np.minimum.reduceat(low * a + high * b, starts))
        keys[:, band] = key
    return keys


def flood(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The group of each set: the position of the first set that links of at least `similarity` reach."""
    sizes = np.array([len(s) for s in sets])
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    group, mark = np.full(len(sets), -1), np.zeros(len(words), bool)
    left, tokens, owner = np.arange(len(sets)), flat, np.repeat(np.arange(len(sets)), sizes)

    def without(gone):
        nonlocal left, tokens, owner
        stay = ~gone
        tokens = tokens[stay[owner]]
        left = left[stay]
        owner = np.repeat(np.arange(len(left)), sizes[left])

    while len(left):
        start = left[0]
        group[start], front = start, [start]
        without(np.arange(len(left)) == 0)
        while front and len(left):
            one = front.pop()
            own = flat[ends[one] - sizes[one] : ends[one]]
            mark[own] = True
            shared = np.bincount(owner[mark[tokens]], minlength=len(left))
            mark[own] = False
            hit = shared >= similarity * (sizes[one] + sizes[left] - shared) - 1e-9
            if hit.any():
                front += left[hit].tolist()
                group[left[hit]] = start
                without(hit)
    return group


def near_copies(docs: DataFrame, columns: list[str], shingle: int = 5, similarity: float = 0.8, text_column: str = "text", radius: int = 3) -> DataFrame:
    """The given columns of each row and `group`, equal for rows that links of at least `similarity` join.

    The bands are made for similarities of 0.8 and more.  Null texts are empty;
    texts without words are one group.  Repeated rows stay; an empty table
    gives no rows; other columns are not read.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("similarity must be from 0.8 to 1")
    schema = docs.select(*columns).schema
    read = docs.select(*columns, F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("__text"))

    def mark(batches):
        for batch in batches:
            for first, texts in text_slices(batch, "__text", SLICE):
                sets = shingles(texts, shingle)
                same = names(sets)
                full = np.flatnonzero([len(s) > 0 for s in sets])
                keys = bands([sets[i] for i in full]).view(np.int64) if len(full) else np.zeros((0, BANDS), np.int64)
                counts = np.zeros(len(sets), np.int32)
                counts[full] = BANDS
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(first, len(texts)) for i in range(len(columns))], pa.array(same), pa.array(majority(sets).view(np.int64)), listed], [*columns, "same", "fp", "bands"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    marked = checkpoint(read.mapInArrow(tidy(mark), f"{kinds}, same long, fp long, bands array<long>"))
    # Equal sets go on as one, and have one fingerprint; a star of only one set links nothing.
    sets_of = marked.groupBy("same").agg(F.first("fp").alias("bits"), F.first("bands").alias("bands"))
    full = checkpoint(sets_of.where(F.size("bands") > 0).select("same", "bits"))
    near = checkpoint(stars(checkpoint(full.select(F.col("bits").alias("fp"), F.col("bits").alias("label")).distinct()), radius)).select(F.col("fp").alias("bits"), "centre")
    by_tree = full.join(near, "bits", "left").select(F.coalesce("centre", "bits").alias("star"), F.col("same").alias("fp")).distinct()
    keys = by_tree.unionByName(sets_of.select(F.explode("bands").alias("star"), F.col("same").alias("fp")))
    shared = keys.groupBy("star").agg(F.count("*").alias("n")).where("n > 1").select("star")
    member = checkpoint(keys.join(shared, "star").select("star", "fp", F.col("fp").alias("label")))
    proposed = spread(member).select(F.col("fp").alias("same"), "label")
    # One text of each set that was proposed; the sets are made again from these alone.
    first = checkpoint(marked.join(proposed, "same").groupBy("same", "label").agg(F.min(F.struct(*columns)).alias("row")).select("same", "label", "row.*"))
    on = [read[c].eqNullSafe(first[c]) for c in columns]
    texts = read.join(first, on).select("same", "label", "__text")

    def link(table):
        same, found = table.column("same").to_numpy(), table.column("__text").to_pylist()
        sets = shingles(found, shingle)
        right = np.flatnonzero(names(sets) == same)  # rows of equal columns may hold other texts
        same, at = np.unique(same[right], return_index=True)
        if not len(same):
            return pa.table({"same": pa.array([], pa.int64()), "group": pa.array([], pa.int64())})
        return pa.table({"same": same, "group": same[flood([sets[i] for i in right[at]], similarity)]})

    linked = checkpoint(texts.groupBy("label").applyInArrow(link, "same long, group long"))
    return marked.join(linked, "same", "left").select(*columns, F.coalesce("group", "same").alias("group"))
