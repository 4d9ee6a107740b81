"""SentencePiece models on the tokenizers library.

The model's protobuf is read field by field; from it come the vocabulary, the
merges or unigram scores, byte fallback, the normaliser and the marker of
white space.  Encoding sends the new runs of a batch to the library together,
which spreads them over its threads, and each new run is compared with the
sentencepiece library.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._util import in_process, text_slices, tidy
from quarry.llm.encoding import ENTRY, MEMO_BYTES, MEMO_LENGTH, id_dtype

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
SLICE, AT_ONCE = 500_000, 4_096


def fields(message: bytes):
    """(number, value) of each field of a protobuf message."""

    def varint(i):
        value = shift = 0
        while True:
            byte = message[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(message):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n = {1: 8, 5: 4}.get(key & 7)
            if n is None:
                n, i = varint(i)
            value, i = message[i : i + n], i + n
        yield key >> 3, value


class Model:
    """What a model file holds."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        self.bpe = trainer.get(3, 1) == 2
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normaliser.get(2, b"")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs that make a piece, best piece first."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER, UNUSED)}
        found = []
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                if piece[:k] in ids and piece[k:] in ids:
                    found.append((-self.pieces[i][1], i, ids[piece[:k]], piece[:k], piece[k:]))
        return [(a, b) for *_, a, b in sorted(found)]

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if self.bpe:
            made = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=0)
        else:
            made = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        out = Tokenizer(made)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        ends = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
        return out

    def cuttable(self) -> bool:
        """Whether no piece goes on past the start of a word or past a line feed, so that words can be encoded one by one."""
        return not self.charsmap and not self.squeeze and self.dummy_prefix and not any(MARK in p.lstrip(MARK) or "\n" in p and len(p) > 1 for p, _, _ in self.pieces)


class PieceEncoder:
    """encode(texts) gives the ids of each as bytes, and whether they agree with the sentencepiece library."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import normalizers

        with open(path, "rb") as f:
            data = f.read()
        self.model = Model(data)
        self.tokenizer, self.cuttable = self.model.tokenizer(), self.model.cuttable()
        if self.cuttable:  # runs carry their mark
            self.tokenizer.normalizer = normalizers.Sequence([])
            data += b"\x1a\x02\x18\x00"  # protobuf merges a later message into the first: no dummy prefix
        self.other = SentencePieceProcessor(model_proto=data)
        self.dtype = id_dtype(len(self.model.pieces))
        self.memo: dict[str, bytes] = {}
        self.held = 0
        self.bad: set[str] = set()
        self.edge = re.compile(f"(?<=[^{MARK}])(?={MARK})")
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.cuttable:
            return [text]
        if "  " in text or text[0] == " " or "\0" in text or MARK in text:
            return self.edge.split(MARK + text.replace(" ", MARK))
        return (MARK + text.replace("\n", "\0\n\0").replace(" ", "\0" + MARK)).split("\0")

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        cut = [self.split(t) for t in texts]
        new = list(set().union(*cut).difference(self.memo)) if cut else []
        for k in range(0, len(new), AT_ONCE):
            some = new[k : k + AT_ONCE]
            ids = [e.ids for e in self.tokenizer.encode_batch(some, add_special_tokens=False)]
            told = self.other.encode([r.replace(MARK, " ") for r in some] if self.cuttable else some, num_threads=1)
            self.bad.update(r for r, a, b in zip(some, ids, told) if a != b)
            self.memo.update((r, np.array(x, self.dtype).tobytes()) for r, x in zip(some, ids))
        out = [b"".join(map(self.memo.__getitem__, runs)) for runs in cut]
        same = [not self.bad or self.bad.isdisjoint(runs) for runs in cut]
        for r in new:
            if len(r) > MEMO_LENGTH:
                del self.memo[r]
                self.bad.discard(r)
            else:
                self.held += ENTRY + 4 * len(r) + len(self.memo[r])
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.bad.clear()
            self.held = 0
        return out, same

    def decode(self, ids: bytes) -> str:
        found = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, self.dtype).tolist()))
        return (found[1:] if self.model.dummy_prefix and found[:1] == b" " else found).decode("utf-8", "replace")


def encode(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (little-endian, 2 bytes each, 4 for more than 65,536 pieces), n_tokens, parity.

    `model` is the path of a SentencePiece model on every executor.  A null or
    empty text has no ids; null ids and repeated rows stay; an empty table
    gives no rows; other columns are not read.  parity is true where every run
    of the text has the same ids in the sentencepiece library.
    """

    def run(batches):
        encoder = in_process(("pieces", model), lambda: PieceEncoder(model))
        width = np.dtype(encoder.dtype).itemsize
        for batch in batches:
            for first, texts in text_slices(batch, "text", SLICE):
                ids, same = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(ids, pa.binary()), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(same)], ["doc_id", "ids", "n_tokens", "parity"])

    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return read.mapInArrow(tidy(run, ("pieces", model)), "doc_id long, ids binary, n_tokens long, parity boolean")


def decode(coded: DataFrame, model: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """doc_id, text of rows that `encode` made.

    Null or empty ids give an empty text; a null doc_id and repeated rows
    stay; an empty table gives no rows; other columns are not read.
    """

    def run(batches):
        encoder = in_process(("pieces", model), lambda: PieceEncoder(model))
        for batch in batches:
            texts = [encoder.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select(F.col(id_column).cast("long").alias("doc_id"), F.col(ids_column).alias("ids")).mapInArrow(tidy(run, ("pieces", model)), "doc_id long, text string")


def digest(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), parity, round_trip (decoding gives the text).

    A null or empty text has no tokens, the crc of nothing (0), and makes the
    round trip; null ids and repeated rows stay; an empty table gives no rows;
    other columns are not read.
    """

    def run(batches):
        encoder = in_process(("pieces", model), lambda: PieceEncoder(model))
        width = np.dtype(encoder.dtype).itemsize
        for batch in batches:
            for first, texts in text_slices(batch, "text", SLICE):
                ids, same = encoder.encode(texts)
                crc = [zlib.crc32(np.frombuffer(x, encoder.dtype).astype("<u4")) for x in ids]
                back = [encoder.decode(x) == t for x, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(same), pa.array(back)], ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"])

    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return read.mapInArrow(tidy(run, ("pieces", model)), "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean")
