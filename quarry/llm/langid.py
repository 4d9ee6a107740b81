"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each slot holds a bitmask,
and the AND of an n-gram's slots is the set of languages that contain it.  A
text's n-grams are looked up together; the popcount of each language's slice,
corrected for that slice's rate of false positives, decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._util import Shared, filter_rows, id_crc, lasting, text_slices, tidy

ORDERS = (3, 4)
SLOTS = 1 << 18
HASHES = 3
SLICE = 400_000
BITS = 63


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def pieces(text: str) -> list[str]:
    """A long text in parts of SLICE characters and what is left of the word that they end in, so that no word is cut."""
    out, at = [], 0
    while len(text) - at > 2 * SLICE:
        end = at + SLICE
        while end < len(text) and text[end].isalpha():
            end += 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of its text) of the n-grams of the texts' words.

    Texts are lower-cased; what isn't a letter becomes one space, and a space
    stands at both ends.  An n-gram has no space inside.
    """
    letters = lasting("letters", letter_table)
    texts = [t.lower() for t in texts]
    code = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    owner = np.concatenate([owner[:1], owner])[: len(code)] if len(texts) else owner
    is_letter = letters[code]
    kept = is_letter.copy()
    kept[1:] |= is_letter[:-1]  # the first character after a word stays, as its space
    kept[0] = True
    code, owner = np.where(is_letter, code, 32)[kept].astype(np.uint64), owner[kept]
    space = code == 32
    found, whose = [], []
    for n in ORDERS:
        if len(code) < n:
            continue
        m = len(code) - n + 1
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[j : j + m]
        fit = ~np.logical_or.reduce([space[j : j + m] for j in range(1, n - 1)])
        h = h[fit]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
        h ^= h >> np.uint64(32)
        found.append(h)
        whose.append(owner[1:][: m][fit] if n > 1 else owner[:m][fit])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(whose)


def slots(hashes: np.ndarray, size: int, k: int):
    """The k slots of each hash, one array at a time."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    for i in range(k):
        yield ((hashes + np.uint64(i) * step) % np.uint64(size)).astype(np.int64)


class Filter:
    """masks: (words, slots) of int64; bit b of word w is language 63 * w + b."""

    def __init__(self, languages: list[str], masks: np.ndarray, hashes: int):
        self.languages, self.masks, self.hashes = languages, masks, hashes
        fill = np.array([(masks[i // BITS] >> (i % BITS) & 1).mean() for i in range(len(languages))])
        self.false = fill**hashes

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and of these how many each language's slice holds."""
        h, owner = grams(texts)
        n = np.bincount(owner, minlength=len(texts))
        hits = np.zeros((len(texts), len(self.languages)), np.int64)
        if len(h):
            for w in range(len(self.masks)):
                mask = np.full(len(h), -1, np.int64)
                for slot in slots(h, self.masks.shape[1], self.hashes):
                    mask &= self.masks[w][slot]
                for i in range(w * BITS, min(len(self.languages), (w + 1) * BITS)):
                    hits[:, i] = np.bincount(owner[(mask >> (i % BITS)) & 1 == 1], minlength=len(texts))
        return n, hits

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """lang_pred, score, coverage of each text."""
        parts, whose = [], []
        for i, t in enumerate(texts):
            for p in pieces(t):
                parts.append(p)
                whose.append(i)
        n, hits = self.counts(parts)
        total, held = np.bincount(whose, n, minlength=len(texts)), np.zeros((len(texts), len(self.languages)))
        np.add.at(held, whose, hits)
        share = np.clip((held / np.maximum(total, 1)[:, None] - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        order = np.argsort(-share, axis=1, kind="stable")
        first = np.take_along_axis(share, order[:, :1], 1)[:, 0]
        second = np.take_along_axis(share, order[:, 1:2], 1)[:, 0] if len(self.languages) > 1 else np.zeros(len(texts))
        known = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        score = np.where(known, first / np.maximum(first + second, 1e-9), 0.0)
        return [self.languages[i] if k else "und" for i, k in zip(order[:, 0], known)], score, np.where(known, first, 0.0)


def fit(docs: DataFrame, sample: int = 4_000, least: int = 2, share: float = 2e-5, size: int = SLOTS, hashes: int = HASHES, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Filter:
    """The filter of the languages of the rows with a language and crc32(id) mod 3 not 1.

    `sample` bounds the expected number of rows read of each language; they
    are taken by a hash of their id.  An n-gram enters a language's slice if it
    is seen `least` times and makes up `share` of the language's n-grams; on a
    table so small that it leaves a language none, texts of that language
    have no n-gram of it.  Languages stand in the order of their rows, most
    first, then by name: of languages that fit a text equally well the first
    is told.  An empty table, or one without languages, gives a filter of none.
    """
    taught = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang")).where(F.col("lang").isNotNull() & (id_crc("id") % 3 != 1))
    sizes = {r["lang"]: r["n"] for r in taught.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").collect()}
    languages = list(sizes)
    if not languages:
        return Filter([], np.zeros((1, size), np.int64), hashes)
    scale = 1 << 30
    number = {lang: i for i, lang in enumerate(languages)}
    keep = {lang: int(scale * min(1.0, sample / n)) for lang, n in sizes.items()}
    if min(keep.values()) < scale:
        limit = F.create_map(*[F.lit(x) for pair in keep.items() for x in pair])
        taught = taught.where(F.pmod(F.xxhash64("id"), F.lit(scale)) < limit[F.col("lang")])

    def count(batches):
        for batch in batches:
            langs = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for first, texts in text_slices(batch, "text", SLICE):
                parts = [(p, langs[first + i]) for i, t in enumerate(texts) for p in pieces(t)]
                h, owner = grams([p for p, _ in parts])
                lang = np.array([x for _, x in parts], np.int64)[owner]
                for i in np.unique(lang):
                    value, times = np.unique(h[lang == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), i, np.int32)), pa.array(value.view(np.int64)), pa.array(times.astype(np.int64))], ["lang", "gram", "n"])

    counted = taught.select("text", "lang").mapInArrow(tidy(count), "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    whole = counted.groupBy("lang").agg(F.sum("n").alias("whole"))
    kept = counted.join(whole, "lang").where((F.col("n") >= least) & (F.col("n") >= share * F.col("whole")))

    def place(batches):
        for batch in batches:
            lang, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for slot in slots(h, size, hashes):
                yield pa.RecordBatch.from_arrays([pa.array((lang // BITS).astype(np.int32)), pa.array(slot), pa.array(np.int64(1) << (lang % BITS).astype(np.int64))], ["word", "slot", "bit"])

    placed = kept.select("lang", "gram").mapInArrow(tidy(place), "word int, slot long, bit long").groupBy("word", "slot").agg(F.bit_or("bit").alias("mask"))
    masks = np.zeros(((len(languages) + BITS - 1) // BITS, size), np.int64)
    for r in placed.toLocalIterator():
        masks[r["word"], r["slot"]] = r["mask"]
    return Filter(languages, masks, hashes)


def predict(docs: DataFrame, model: Filter, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, coverage for each row.

    A text that is null or has no letters is `und` with score 0.  score is the
    best language's corrected share of n-grams against that of the next;
    coverage is the share itself.  A null id is not held out; repeated rows
    stay; an empty table gives no rows; other columns are not read.
    """
    held = Shared(docs.sparkSession, model)

    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch, "text", SLICE):
                lang, score, coverage = held.value().decide(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(lang, pa.string()), pa.array(score), pa.array(coverage)], ["doc_id", "lang_pred", "score", "coverage"])

    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    told = read.mapInArrow(tidy(run, held.key), "doc_id long, lang_pred string, score double, coverage double")
    return told.select("doc_id", F.coalesce(id_crc("doc_id") % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "coverage")


def identify(docs: DataFrame, **options) -> DataFrame:
    """Fit on the rows with a language, and predict every row."""
    return predict(docs, fit(docs, **options))


def select(docs: DataFrame, model: Filter, coverage: float, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, in a learned language: those of `und` or of less coverage go.

    Without any learned language nothing can be told and all rows with a letter stay.
    """
    held = Shared(docs.sparkSession, model)

    def decide(texts):
        if not held.value().languages:
            return [any(map(str.isalpha, t)) for t in texts]
        lang, _, share = held.value().decide(texts)
        return (np.array(lang, object) != "und") & (share >= coverage)

    return filter_rows(docs, text_column, decide, held.key)
