"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated word-bigram models, one of toxic and one of ordinary texts,
share their lower orders: a class bigram backs off to the class unigram, and
that to continuation counts over both classes.  Every word and pair of words of
the sample is in both; each is followed as far as its evidence, the
log-likelihood ratio of its document counts, tells the classes apart, and the
shared probability stands for the rest.  A text's two log-likelihoods per token
are compared, and a logistic curve fitted on the sample turns their difference
into a score.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._util import Shared, checkpoint, filter_rows, id_crc, text_slices, tidy

SLICE = 500_000
LONGEST = 64
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; one of over LONGEST characters goes by its digest."""
    found = WORD.findall(text.lower())
    if max(map(len, found), default=0) > LONGEST:
        found = [w if len(w) <= LONGEST else "~" + hashlib.sha256(w.encode("utf-8", "surrogatepass")).hexdigest() for w in found]
    return found


#: How sharply the query's weights rise about `least`.
STEEP = 4.0


def evidence(toxic: np.ndarray, ordinary: np.ndarray, n_toxic: int, n_ordinary: int) -> np.ndarray:
    """G, the log-likelihood ratio of two document counts against one common rate."""
    both, share = np.maximum(toxic + ordinary, 1), n_toxic / (n_toxic + n_ordinary)
    part = lambda n, p: np.where(n > 0, n * np.log(np.maximum(n, 1) / (both * p)), 0.0)
    return np.maximum(2 * (part(toxic, share) + part(ordinary, 1 - share)), 0.0)


def weights(g: np.ndarray, least: float, steep: float) -> np.ndarray:
    """How far the class models are followed at evidence g: half at `least`; all or nothing if `steep` is infinite."""
    if math.isinf(steep):
        return (g >= least).astype(float)
    return g**steep / np.maximum(g**steep + least**steep, 1e-300)


def hashes(found: list[str]) -> np.ndarray:
    """Spark's xxhash64 of each string."""
    import xxhash

    known = {w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in set(found)}
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashed(x: np.ndarray, seed) -> np.ndarray:
    """Spark's xxhash64 of longs with a seed."""
    p1, p2, p3, p4, p5 = PRIMES
    h = (seed + p5 + np.uint64(8)) ^ (turned(x * p2, 31) * p1)
    h = turned(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return hashed(w, hashed(u, np.uint64(42)))


class Places:
    """The place in a table of each known key: sorted hashes, and equal numbers kept once."""

    def __init__(self, keys: np.ndarray, places: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.places = keys[order], places[order].astype(np.int32)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for unknown ones."""
        if not len(self):
            return np.full(len(keys), -1, np.int32)
        asked, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self) - 1)
        return np.where(self.keys[at] == asked, self.places[at], -1)[back]


class Model:
    """Two models, columns toxic and ordinary, over hashed words and pairs of words; unknown words take the last row of the words' tables."""

    def __init__(self, unigrams: Places, bigrams: Places, level: np.ndarray, single: np.ndarray, context: np.ndarray, back: np.ndarray, own: np.ndarray, weight: np.ndarray):
        self.unigrams, self.bigrams = unigrams, bigrams
        self.level, self.single = level, single  # a word's logarithm as it is followed, its class probability
        self.context, self.back = context, back  # tokens after a word, and the share of them that the discount frees
        self.own, self.weight = own, weight  # a pair's discounted counts, how far they are followed
        self.curve = np.array([-3.0, 0.0])

    def likelihoods(self, text: str) -> tuple[float, float, int]:
        """(toxic, ordinary, tokens): the two models' log-likelihoods per token, 0 without tokens."""
        return (*self.compare([text])[0].tolist(), len(words(text)))

    def compare(self, texts: list[str]) -> np.ndarray:
        """Columns: toxic and ordinary log-likelihood per token."""
        found = [words(t) for t in texts]
        sizes = np.array([len(f) for f in found], np.int64)
        h = hashes([w for f in found for w in f])
        if not len(h) or not len(self.unigrams):
            return np.zeros((len(texts), 2))
        at = self.unigrams.find(h)
        told = self.level[at]
        pair = self.bigrams.find(pair_keys(h[:-1], h[1:]))
        ends = np.cumsum(sizes)
        pair[ends[(ends > 0) & (ends < len(h))] - 1] = -1  # of two texts
        first = np.flatnonzero(pair >= 0)
        pair, u, w = pair[first], at[first], at[first + 1]
        after = self.context[u]
        p = np.where(after > 0, self.own[pair] / np.maximum(after, 1) + self.back[u] * self.single[w], self.single[w])
        told[first + 1] += self.weight[pair][:, None] * (np.log(p) - told[first + 1])
        owner = np.repeat(np.arange(len(texts)), sizes)
        return np.stack([np.bincount(owner, told[:, y], len(texts)) for y in (0, 1)], axis=1) / np.maximum(sizes, 1)[:, None]

    def features(self, found: np.ndarray) -> np.ndarray:
        """The constant and the difference of the likelihoods per token, on a scale that is fine near 0."""
        return np.stack([np.ones(len(found)), np.arcsinh((found[:, 0] - found[:, 1]) * 1000)], axis=1)

    def score(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(found) @ self.curve, -30, 30)))


def constant(odds: float) -> Model:
    """The model that gives every text the same score."""
    none, flat = Places(np.zeros(0, np.uint64), np.zeros(0, np.int32)), np.zeros((1, 2))
    model = Model(none, none, flat, flat, flat, flat, flat, flat[:, 0])
    model.curve = np.array([odds, 0.0])
    return model


def places(rows: DataFrame, stats: list[str]) -> tuple[Places, np.ndarray]:
    """The places of the keys, and the table: `stats` of rows, each combination once."""
    code = F.xxhash64(*stats).alias("code")
    table = rows.groupBy(*stats).agg(F.count("*").alias("n")).select(code, *stats).toArrow()
    codes = table.column("code").to_numpy()
    order = np.argsort(codes)
    got = rows.select("key", code).toArrow()
    at = np.searchsorted(codes[order], got.column("code").to_numpy()).astype(np.int32)
    return Places(got.column("key").to_numpy().view(np.uint64), at), np.stack([table.column(c).to_numpy()[order] for c in stats], axis=1).astype(float)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """A logistic curve over the columns of x, of which the first is constant, by damped Newton steps.

    A row counts as `weight` rows.  Columns are scaled first; the ridge, on all
    but the constant, keeps the curve finite where the classes part cleanly.
    """
    middle = np.average(x, axis=0, weights=weight)
    wide = np.sqrt(np.average((x - middle) ** 2, axis=0, weights=weight))
    middle[0], wide[wide == 0] = 0, 1
    z, pull = (x - middle) / wide, np.array([0.0, *[ridge] * (x.shape[1] - 1)])

    def loss(w):
        t = z @ w
        return weight @ (np.logaddexp(0, t) - y * t) + (pull * w * w).sum() / 2

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + pull * w
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(pull + 1e-9), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w) - 1e-4 * size * (slope @ step):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    out = w / wide
    out[0] -= (out[1:] * middle[1:]).sum()
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 10_000, least: float = 24.0, discount: float = 0.75, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", steep: float = math.inf) -> Model:
    """The model of the labelled rows whose crc32(id) mod 4 is not 2.

    `sample` bounds the expected number of rows read of each class; they are
    taken by a hash of their id, and the curve weighs each by the rows it
    stands for, so scores don't move with the size of the input.  An expression
    of evidence G is followed with the weight 1 / (1 + (least / G) ** steep);
    with an infinite `steep` only those of `least` or more tell anything.
    Equal texts count once.  A label that differs between rows of one id counts as toxic;
    labels other than 0 and 1 and rows without an id or a label teach nothing.
    Empty tables, or labels of one class only, give a model that scores all
    texts alike: near 1 if only toxic labels are known, else near 0.
    """
    marked = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull() & (id_crc("id") % 4 != 2))
    marked = marked.groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in marked.where(F.col("y").isin(0, 1)).groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return constant(20.0 if sizes.get(1) else -20.0)
    scale = 1 << 30
    keep = {y: int(scale * min(1.0, sample / sizes[y])) for y in (0, 1)}
    stands = {y: scale / keep[y] for y in (0, 1)}  # labelled rows for each row taken
    taken = F.pmod(F.xxhash64("id"), F.lit(scale)) < F.when(F.col("y") == 1, keep[1]).when(F.col("y") == 0, keep[0])
    chosen = F.broadcast(marked.where(taken))  # at most 2 * sample rows are expected
    read = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).join(chosen, "id").select("y", F.coalesce("text", F.lit("")).alias("text"))
    read = checkpoint(read.withColumn("same", F.xxhash64("text")).groupBy("same").agg(F.max("y").alias("y"), F.first("text").alias("text")).select("y", "text"))

    def count(batches):
        for batch in batches:
            ys = batch.column(0).to_pylist()
            for first, texts in text_slices(batch, "text", SLICE):
                held: dict[tuple, list[int]] = {}
                for y, text in zip(ys[first:], texts):
                    seen = set()
                    found = words(text)
                    for pair in zip(["", *found], found):
                        row = held.setdefault(pair, [0, 0, 0, 0])
                        row[y] += 1
                        if pair not in seen:
                            seen.add(pair)
                            row[2 + y] += 1
                    single = set(found)
                    for w in single:
                        held.setdefault((None, w), [0, 0, 0, 0])[2 + y] += 1
                keys = list(held)
                cols = list(zip(*held.values())) if held else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *[pa.array(c, pa.int64()) for c in cols]], ["u", "w", "n0", "n1", "d0", "d1"])

    sums = [F.sum(c).alias(c) for c in ("n0", "n1", "d0", "d1")]
    counted = checkpoint(read.mapInArrow(tidy(count), "u string, w string, n0 long, n1 long, d0 long, d1 long").groupBy("u", "w").agg(*sums))
    docs_of = {r["y"]: r["n"] for r in read.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = docs_of.get(1, 0), docs_of.get(0, 0)
    pairs = counted.where(F.col("u").isNotNull())
    # Shared continuation counts, class unigrams and class contexts.
    by_word = pairs.groupBy("w").agg(F.count("*").alias("left"), F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
    spread = counted.where(F.col("u").isNull()).select("w", "d0", "d1")
    whole = by_word.agg(F.sum("left").alias("left"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.count_if(F.col("c0") > 0).alias("t0"), F.count_if(F.col("c1") > 0).alias("t1"), F.count("*").alias("types")).first()
    if not whole["c0"] or not whole["c1"]:
        return constant(math.log(n1 * stands[1] / (n0 * stands[0])) if n0 and n1 else 20.0 if n1 else -20.0)
    contexts = pairs.groupBy(F.col("u").alias("w")).agg(*[F.sum(f"n{y}").alias(f"s{y}") for y in (0, 1)], *[F.count_if(F.col(f"n{y}") > 0).alias(f"k{y}") for y in (0, 1)])
    after = [F.coalesce(c, F.lit(0)).alias(c) for c in ("s0", "s1", "k0", "k1")]
    # The words and the pairs of the sample, whose size `sample` bounds: 16 bytes each.
    known = checkpoint(by_word.join(spread, "w").join(contexts, "w", "left").select(F.xxhash64("w").alias("key"), "left", "c0", "c1", "d0", "d1", *after))
    unigrams, table = places(known, ["left", "c0", "c1", "d0", "d1", "s0", "s1", "k0", "k1"])
    left, c0, c1, d0, d1, s0, s1, k0, k1 = np.concatenate([table, np.zeros((1, 9))]).T  # the last row is for unknown words
    follow = weights(evidence(d1, d0, n1, n0), least, steep)
    # Where weights are all or nothing, words of no weight that stand after one word only are as good as unknown.
    base = np.where((follow == 0) & (left < 2), 0.0, left) if math.isinf(steep) else left
    shared = (base + 0.5) / (whole["left"] + 0.5 * whole["types"])
    single = np.stack([np.maximum(c - discount, 0) / whole[f"c{y}"] + discount * whole[f"t{y}"] / whole[f"c{y}"] * (left + 0.5) / (whole["left"] + 0.5 * whole["types"]) for y, c in ((1, c1), (0, c0))], axis=1)
    level = np.log(shared)[:, None] + follow[:, None] * (np.log(single) - np.log(shared)[:, None])
    context = np.stack([s1, s0], axis=1)
    back = discount * np.stack([k1, k0], axis=1) / np.maximum(context, 1)
    bigrams, table = places(pairs.where(F.col("u") != "").select(F.xxhash64(F.xxhash64("u"), F.xxhash64("w")).alias("key"), "n0", "n1", "d0", "d1"), ["n0", "n1", "d0", "d1"])
    m0, m1, e0, e1 = table.T
    model = Model(unigrams, bigrams, level, single, context, back, np.maximum(np.stack([m1, m0], axis=1) - discount, 0), weights(evidence(e1, e0, n1, n0), least, steep))
    held = Shared(docs.sparkSession, model)

    def feature(batches):
        for batch in batches:
            ys = batch.column(0).to_pylist()
            for first, texts in text_slices(batch, "text", SLICE):
                x = held.value().compare(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ys[first : first + len(texts)], pa.int32()), pa.array(x[:, 0]), pa.array(x[:, 1])], ["y", "a", "b"])

    rows = np.array(read.select("y", "text").mapInArrow(tidy(feature, held.key), "y int, a double, b double").collect(), float).reshape(-1, 3)
    model.curve = logistic(model.features(rows[:, 1:]), rows[:, 0], np.where(rows[:, 0] == 1, stands[1], stands[0]))
    held.data.unpersist()
    return model


def predict(docs: DataFrame, model: Model, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_ll, ordinary_ll (log-likelihoods per token) for each row.

    A null or empty text has no tokens, both likelihoods 0 and the score of no
    evidence; a null id is not held out; repeated rows stay; an empty table
    gives no rows; other columns are not read.  Without labels of both classes
    the score is near 0, or near 1 if all labels are toxic.
    """
    held = Shared(docs.sparkSession, model)

    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch, "text", SLICE):
                x = held.value().compare(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(held.value().score(x)), pa.array(x[:, 0]), pa.array(x[:, 1])], ["doc_id", "score", "toxic_ll", "ordinary_ll"])

    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    told = read.mapInArrow(tidy(run, held.key), "doc_id long, score double, toxic_ll double, ordinary_ll double")
    return told.select("doc_id", F.coalesce(id_crc("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "toxic_ll", "ordinary_ll")


def select(docs: DataFrame, model: Model, threshold: float = 0.3, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, that aren't predicted to be toxic."""
    held = Shared(docs.sparkSession, model)
    return filter_rows(docs, text_column, lambda texts: held.value().score(held.value().compare(texts)) < threshold, held.key)
