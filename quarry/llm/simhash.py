"""SimHash near-duplicates, joined through vantage-point trees.

Distinct fingerprints are dealt to shards by the upper levels of a
vantage-point tree, which is built on a bounded sample.  A node holds a
vantage point and a radius: fingerprints within the radius go inside, the
others outside.  If two fingerprints differ in at most r bits, the triangle
inequality bounds the difference of their distances to the vantage point by r.
So an inner fingerprint whose distance is within r of the radius is copied to
the outer side as well, and every linked pair meets in some shard.  Shards that
turn out too large for a task are split further, by trees built on samples of
their own.  A shard goes on the same way down to small leaves and compares
fingerprints there.

A shard returns its groups as stars, never as pairs; the stars of all shards
are merged by alternating large and small stars, in a number of
rounds that grows with the logarithm of a group.
"""

from __future__ import annotations

import copy
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._util import checkpoint, text_slices, tidy

SEED = 42
SLICE = 500_000
BLOCK = 1 << 16
SAMPLE = 20_000
SHARD_ROWS = 4_096
#: A shard's fingerprints at most, where the vantage points can part them.
LARGEST_SHARD = 1_000_000
#: Fingerprints on the driver at most, in expectation, when large shards are split.
SAMPLE_ALL = 4_000_000
LEAF = 768
LEAST_SAMPLE = 64
NONE = np.iinfo(np.int64).max


def fingerprint(texts: list[str], shingle: int = 3) -> np.ndarray:
    """The 64-bit SimHash of each text: bit b is 1 if over half of the shingles' hashes have it."""
    import xxhash

    ones = np.zeros((len(texts), 64), np.int64)
    n = np.zeros(len(texts), np.int64)
    rows, held, owners = [], 0, []

    def flush():
        hashes = np.concatenate(rows)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sizes = np.array([len(r) for r in rows])
        np.add.at(ones, owners, np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64))

    for i, text in enumerate(texts):
        words = text.encode().lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            parts = [joined]
        else:
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            parts = None
            a, b = (ends - sizes)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
        count = len(words) - shingle + 1 if parts is None else 1
        n[i] = count
        for k in range(0, count, BLOCK):
            some = parts or [joined[x:y] for x, y in zip(a[k : k + BLOCK], b[k : k + BLOCK])]
            rows.append(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in some), np.uint64, len(some)))
            owners.append(i)
            held += len(some)
            if held >= BLOCK:
                flush()
                rows, held, owners = [], 0, []
    if rows:
        flush()
    return (np.packbits(2 * ones > n[:, None], axis=1).view(">u8").astype(np.uint64)).reshape(-1)


def majority(sets: list[np.ndarray]) -> np.ndarray:
    """The 64-bit SimHash of each set of hashes: bit b is 1 if over half of them have it."""
    ones = np.zeros((len(sets), 64), np.int64)
    for i, s in enumerate(sets):
        for k in range(0, len(s), BLOCK):
            ones[i] += np.unpackbits(s[k : k + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return (np.packbits(2 * ones > np.array([[len(s)] for s in sets]).reshape(-1, 1), axis=1).view(">u8").astype(np.uint64)).reshape(-1)


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long)."""

    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(fingerprint(texts, shingle).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


def split(points: np.ndarray, radius: int, rng) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that leave the fewest pairs; None if none makes both sides clearly smaller.

    Near the best radius both sides hold about 0.65 of points that lie at random.
    """
    best, found = 0.95 * float(len(points)) ** 2, None
    for v in points[rng.integers(0, len(points), 4)]:
        inside = np.cumsum(np.bincount(np.bitwise_count(points ^ v), minlength=65)).astype(np.float64)
        shell = inside - np.concatenate([np.zeros(radius), inside[: 65 - radius]])
        outside = inside[-1] - inside + shell
        cost = inside**2 + outside**2
        mu = int(cost.argmin())
        if cost[mu] < best:
            best, found = cost[mu], (v, mu)
    return found


def sides(points: np.ndarray, v, mu: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the points that go inside and outside; inner points near the boundary go to both."""
    d = np.bitwise_count(points ^ v)
    return np.flatnonzero(d <= mu), np.flatnonzero(d > mu - radius)


class Tree:
    """The upper tree, as arrays: vantage point, radius, inner and outer node of each node; the inner node is 0 for a shard."""

    def __init__(self):
        self.points, self.radii = np.zeros(1, np.uint64), np.zeros(1, np.int64)
        self.inner, self.outer = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def grow(self, samples: dict[int, np.ndarray], depth: int, radius: int) -> bool:
        """Split shards by samples of them, `depth` levels at most; whether any was split."""
        rng, new, size = np.random.default_rng(0), [], len(self.points)
        changed = {}
        todo = [(at, points, depth) for at, points in sorted(samples.items())]
        while todo:
            at, points, levels = todo.pop()
            found = split(points, radius, rng) if levels and len(points) >= 2 else None
            if found:
                inner, outer = sides(points, *found, radius)
                a, b = size + len(new), size + len(new) + 1
                new += [None, None]
                changed[at] = (found[0], found[1], a, b)
                todo += (a, points[inner], levels - 1), (b, points[outer], levels - 1)
        for name in ("points", "radii", "inner", "outer"):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.zeros(len(new), old.dtype)]))
        for at, (v, mu, a, b) in changed.items():
            self.points[at], self.radii[at], self.inner[at], self.outer[at] = v, mu, a, b
        return bool(changed)

    def route(self, points: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
        """(shard, positions of the points in it)."""
        out, todo = [], [(0, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            if not self.inner[at]:
                out.append((at, rows))
                continue
            a, b = sides(points[rows], self.points[at], self.radii[at], radius)
            todo += (int(self.inner[at]), rows[a]), (int(self.outer[at]), rows[b])
        return out


def upper_tree(nodes: DataFrame, radius: int) -> Tree:
    """The tree whose shards hold LARGEST_SHARD fingerprints at most, but for those that no vantage point parts.

    The first levels come from an expected SAMPLE fingerprints.  While shards
    are too large they are counted and split by samples of them: SAMPLE each,
    or SAMPLE_ALL among them, in expectation, reach the driver.
    """
    tree, total, whole = Tree(), nodes.count(), 1 << 30
    drawn = F.pmod(F.xxhash64("fp"), F.lit(whole))
    some = nodes.select("fp").where(drawn < int(whole * min(1.0, SAMPLE / max(total, 1))))
    sample = np.sort(some.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))
    depth = max(6, math.ceil(math.log2(max(1, total) / SHARD_ROWS)))
    levels = lambda n: max(1, int(math.log(max(n, 2) / LEAST_SAMPLE, 1.5)) + 1)
    grown = tree.grow({0: sample}, min(depth, levels(len(sample))), radius)
    stuck: set[int] = set()
    while grown and total > LARGEST_SHARD:
        held = tree

        def count(batches):
            sums: dict[int, int] = {}
            for batch in batches:
                for shard, rows in held.route(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), radius):
                    sums[shard] = sums.get(shard, 0) + len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["shard", "n"])

        large = {r["shard"]: r["n"] for r in nodes.select("fp").mapInArrow(count, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).where(F.col("n") > LARGEST_SHARD).collect() if r["shard"] not in stuck}
        if not large:
            break
        each = min(SAMPLE, SAMPLE_ALL // len(large))
        rates = {shard: int(whole * min(1.0, each / n)) for shard, n in large.items()}

        def draw(batches):
            for batch in batches:
                fp, at = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
                for shard, rows in held.route(fp.view(np.uint64), radius):
                    rows = rows[at[rows] < rates.get(shard, 0)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard)), pa.array(fp[rows])], ["shard", "fp"])

        got = nodes.select("fp", F.pmod(F.xxhash64(F.lit(1), "fp"), F.lit(whole)).alias("at")).mapInArrow(draw, "shard long, fp long").toArrow()
        shard, fp = got.column(0).to_numpy(), got.column(1).to_numpy().view(np.uint64)
        samples = {at: np.sort(fp[shard == at]) for at in large}
        tree = copy.deepcopy(held)
        grown = tree.grow(samples, levels(each), radius)
        stuck |= {at for at in large if not tree.inner[at]}
    return tree


def flood(points: np.ndarray, radius: int) -> np.ndarray:
    """The group of each point: the position of the first point of it."""
    group = np.full(len(points), -1)
    if len(points) <= 4 * LEAF:
        alone = np.concatenate([(np.bitwise_count(points[k : k + 32, None] ^ points) <= radius).sum(axis=1) == 1 for k in range(0, len(points), 32)])
        group[alone] = np.flatnonzero(alone)
    left = np.flatnonzero(group < 0)
    while len(left):
        start, front = left[0], left[:1]
        group[start], left = start, left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            rows = max(1, (1 << 22) // len(left))
            for k in range(0, len(front), rows):
                rest = np.flatnonzero(~hit)
                hit[rest] = (np.bitwise_count(points[front[k : k + rows], None] ^ points[left[rest]]) <= radius).any(axis=0)
            front, left = left[hit], left[~hit]
            group[front] = start
    return group


def groups(points: np.ndarray, radius: int) -> np.ndarray:
    """Connected groups of distinct points within one shard, by a vantage-point tree over them."""
    parent = np.arange(len(points))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    rng, todo = np.random.default_rng(0), [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        found = split(points[rows], radius, rng) if len(rows) > LEAF else None
        if found:
            todo += (rows[x] for x in sides(points[rows], *found, radius))
        elif len(rows) > 1:
            own = flood(points[rows], radius)
            for i in np.flatnonzero(own != np.arange(len(own))):
                a, b = root(rows[i]), root(rows[own[i]])
                parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(points))], np.int64)


def stars(nodes: DataFrame, radius: int) -> DataFrame:
    """fp, centre, label of the groups found in each shard; nodes: distinct fp and its label.

    The fingerprints of a group, but the smallest, are each linked to the smallest.
    """
    tree = upper_tree(nodes, radius)

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for shard, rows in tree.route(fp.view(np.uint64), radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard, np.int32)), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))], ["shard", "fp", "label"])

    def link(key, t):
        fp, label = t.column("fp").to_numpy(), t.column("label").to_numpy()
        order = np.argsort(label, kind="stable")
        fp, label = fp[order], label[order]
        own = groups(fp.view(np.uint64), radius)
        kept = np.flatnonzero(np.bincount(own, minlength=len(own))[own] > 1)
        kept = kept[np.argsort(own[kept], kind="stable")]
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows in np.split(kept, np.flatnonzero(np.diff(own[kept])) + 1) if len(kept) else []:
            for col, x in zip(out, (fp[rows], np.full(len(rows), fp[rows].min()), label[rows])):
                col.append(x)
        return pa.table([np.concatenate(c) for c in out], names=["fp", "centre", "label"])

    return nodes.select("fp", "label").mapInArrow(tidy(deal), "shard int, fp long, label long").groupBy("shard").applyInArrow(link, "fp long, centre long, label long")


def components(nodes: DataFrame, radius: int) -> DataFrame:
    """fp, label: the smallest label that links reach, for fingerprints that have links; nodes: distinct fp and its label."""
    found = checkpoint(stars(nodes, radius))
    return merged(found.select(F.col("fp").alias("u"), F.col("centre").alias("v")), found.select("fp", "label"))


def spread(member: DataFrame) -> DataFrame:
    """fp, label: the smallest label that stars reach; member: star, fp and its label, written already."""
    centre = member.groupBy("star").agg(F.min("fp").alias("v"))
    return merged(member.join(centre, "star").select(F.col("fp").alias("u"), "v"), member.select("fp", "label"))


def merged(found: DataFrame, labels: DataFrame) -> DataFrame:
    """fp, label: the smallest label that links (u, v) reach; labels: fp and its label, for every node.

    In turn, every node hands its larger neighbours to the smallest one, and
    its smaller ones with itself: groups become stars around their smallest
    node.  A node of many links is one row of a minimum, joined to rows that
    Spark can split.
    """
    links = checkpoint(found.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not settled(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = checkpoint(large)  # u is above v in every link
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        links = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        links = checkpoint(links)
    # A fingerprint's label is the same in all its stars.
    owned = labels.groupBy("fp").agg(F.min("label").alias("own"))
    rooted = owned.join(links.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    low = rooted.groupBy("root").agg(F.min("own").alias("label"))
    return checkpoint(rooted.join(low, "root").select("fp", "label"))


def settled(links: DataFrame) -> bool:
    """Whether links, u above v in each, are stars: every u has one link and is no v."""
    ends = links.groupBy("u").agg(F.count("*").alias("n"))
    return ends.where("n > 1").isEmpty() and links.select(F.col("v").alias("u")).distinct().join(ends, "u", "left_semi").isEmpty()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for each row.

    Texts are lower-cased in A-Z and cut at ASCII white space; a text with
    fewer words than a shingle is one shingle; a null or empty text has
    fingerprint zero, linked like any other.  component_id is the smallest
    doc_id that links of at most `radius` differing bits reach, null if they
    reach only null ids.  Repeated rows stay and share their component; an
    empty table gives no rows; other columns are not read.
    """
    if not 0 <= radius < 64:
        raise ValueError("radius must be from 0 to 63")
    marked = checkpoint(fingerprints(docs, shingle, id_column, text_column))
    nodes = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("label")).select("fp", F.coalesce("label", F.lit(int(NONE))).alias("label")))
    linked = components(nodes, radius).withColumnRenamed("label", "far")
    # Written, so that the last join reads two plain shuffles and Spark can split a fingerprint that many rows share.
    final = checkpoint(nodes.join(linked, "fp", "left").select("fp", F.nullif(F.coalesce("far", "label"), F.lit(int(NONE))).alias("component_id")))
    return marked.join(final, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
