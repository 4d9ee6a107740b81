"""Exact and fast batch encoding: each distinct run between cuts is encoded once a block.

A cut is a place that no token can span; the ids of a text are the ids of its
runs put together.  A block's runs are cut, told apart and put together again as
Arrow arrays; only distinct ones become Python strings, a bounded number at
once, and those that repeat in a block are kept for the next ones.  The memo
holds a bounded number of bytes, so memory does not follow the vocabulary of the
corpus; a worker process that another operator uses next gives it back.
"""

from __future__ import annotations

import codecs
import itertools
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.llm._util import in_process as in_process

MEMO_BYTES = 160_000_000
MEMO_LENGTH = 48
#: What a key and its bytes take besides their characters: two objects' heads and a place in the table.
ENTRY = 180
#: Runs that are encoded at once, and pre-tokens whose merges are.
AT_ONCE, TOGETHER = 20_000, 64


class Memo(dict):
    """Bytes of the ids of each key; `make` gives those of many keys.

    It holds about `most` bytes in two generations: when the younger one is
    half of that, the older one goes, but for keys that were asked for since.
    """

    def __init__(self, make, most: int = MEMO_BYTES):
        self.make, self.most, self.held, self.older = make, most, 0, {}

    def of(self, keys: list[str], repeat: list[bool]) -> list[bytes]:
        """The bytes of each of some distinct keys; new ones are kept if they repeat."""
        out = list(map(self.get, keys))
        lost = [i for i, ids in enumerate(out) if ids is None]
        if self.older:
            for i in lost:
                out[i] = self.older.get(keys[i])
        new = [i for i in lost if out[i] is None]
        for i, ids in zip(new, self.make([keys[i] for i in new])):
            out[i] = ids
        for i in lost:
            if repeat[i] and len(keys[i]) <= MEMO_LENGTH:
                self[keys[i]] = out[i]
                self.held += ENTRY + 4 * len(keys[i]) + len(out[i])
                if self.held > self.most / 2:
                    self.older, self.held = dict(self), 0
                    self.clear()
        return out


class RunEncoder:
    """Encodes texts to little-endian ids, each distinct run of a call once.

    `split` gives a text's runs, `encode` the bytes of the ids of each of many
    runs, `plain` tells the texts of an array whose runs `plain_runs` gives.
    Runs that repeat are looked up in a memo first.
    """

    def __init__(self, split, encode, dtype: str, plain=None):
        self.split, self.dtype, self.plain = split, dtype, plain
        self.memo = Memo(encode)

    def __call__(self, texts: list[str]) -> list[bytes]:
        return self.encode(pa.array(texts, pa.string())).to_pylist()

    def encode(self, texts: pa.Array) -> pa.Array:
        """The bytes of each text's ids; a null text is empty."""
        texts = pc.fill_null(texts if texts.nbytes < 1 << 29 else texts.cast(pa.large_string()), "")
        plain = self.plain(texts).to_numpy(zero_copy_only=False) if self.plain else np.zeros(len(texts), bool)
        runs, counts = plain_runs(texts.filter(pa.array(plain)))
        if not plain.all():
            odd = [self.split(t) for t in texts.filter(pa.array(~plain)).to_pylist()]
            runs = pa.concat_arrays([runs, pa.array(list(itertools.chain.from_iterable(odd)), texts.type)])
            counts = np.concatenate([counts, np.fromiter(map(len, odd), np.int64, len(odd))])
        del texts
        coded = runs.dictionary_encode()
        del runs
        repeat = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)) > 1
        known = [pa.array([], pa.large_binary())]
        for k in range(0, len(repeat), AT_ONCE):
            keys = coded.dictionary.slice(k, AT_ONCE).to_numpy(zero_copy_only=False).tolist()
            known.append(pa.array(self.memo.of(keys, repeat[k : k + AT_ONCE].tolist()), pa.large_binary()))
        ids = pa.concat_arrays(known).take(coded.indices)
        if not len(ids):
            return pa.array([b""] * len(plain), pa.large_binary())
        _, starts, data = ids.buffers()
        ends = np.frombuffer(starts, np.int64)[np.concatenate([[0], np.cumsum(counts)])]
        ids = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), data])
        if plain.all():
            return ids
        place = np.empty(len(plain), np.int64)
        place[np.argsort(~plain, kind="stable")] = np.arange(len(plain))
        return ids.take(pa.array(place))


def id_dtype(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


#: What `plain_runs` can't cut: white space that isn't single spaces and line feeds inside a text, and NUL.
ODD = r"[\x00\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z|\A\z"


def plain_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs of texts that `ODD` doesn't find, and how many each has: each space starts a run, each line feed is a run."""
    marked = pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 ")
    runs = pc.split_pattern(marked, "\0")
    return runs.flatten(), pc.list_value_length(runs).to_numpy(zero_copy_only=False).astype(np.int64)


def byte_level(path: str, special: bool = True) -> RunEncoder:
    """The encoder of a byte-level BPE file of the tokenizers library.

    Its pattern starts a new pre-token at each space that stands between two
    characters that are not white space, and a line feed between two such
    characters is a pre-token of its own.  White space that meets white space
    is left inside its run.  With `special`, the string of a special token in a
    text is that token, as the library has it; without, it is ordinary text.
    """
    import json

    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special
    size = tokenizer.get_vocab_size()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = spec.get("pre_tokenizer") or {}
    added = [t for t in spec.get("added_tokens") or () if special or not t.get("special")]
    loose = any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word"))
    code = "H" if size <= 1 << 16 else "I"
    if loose or spec.get("normalizer") or steps.get("type") != "ByteLevel" or steps.get("add_prefix_space") or not steps.get("use_regex", True):
        whole = lambda t: array(code, tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
        return RunEncoder(lambda t: [t] if t else [], lambda runs: list(map(whole, runs)), id_dtype(size))
    # Fixed value: the pattern of the byte-level pre-tokenizer.
    pattern = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(kept)))}
    shapes = "".join(shown[b] for b in range(256))
    word, cut, pieces = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch, re.compile(r"(?<=\S)(?= \S)"), pattern.findall
    tokenize, simple = tokenizer.model.tokenize, regex.compile(r" ?\S+").fullmatch
    tokenizer.model._resize_cache(0)  # the memo holds what repeats
    marks = {t["content"]: array(code, [t["id"]]).tobytes() for t in added}
    mark = re.compile("(" + "|".join(map(re.escape, sorted(marks, key=len, reverse=True))) + ")")
    # A byte that is in no UTF-8 text and in no merge: nothing is merged across it.
    merged = set("".join("".join(m) for m in spec["model"]["merges"]))
    apart = next((b for b in (0xFF, *range(0xF5, 0xFF), 0xC0, 0xC1) if shown[b] in spec["model"]["vocab"] and shown[b] not in merged), None)

    def plain(texts: pa.Array) -> pa.Array:
        odd = pc.match_substring_regex(texts, ODD)
        for m in marks:
            odd = pc.or_(odd, pc.match_substring(texts, m))
        return pc.invert(odd)

    def split(text: str) -> list[str]:
        if not any(m in text for m in marks):
            return cut.split(text) if text else []
        return [run for part in mark.split(text) if part for run in ([part] if part in marks else cut.split(part))]

    def merge(some: list[str]) -> list[bytes]:
        """The bytes of the ids of each pre-token."""
        step, gap = (TOGETHER, bytes([apart])) if apart else (1, b"")
        out, ids = [], array(code)
        for k in range(0, len(some), step):
            data = gap.join([*map(str.encode, some[k : k + step]), b""])
            ids.extend([t.id for t in tokenize(codecs.charmap_decode(data, "strict", shapes)[0])])
            if not apart:
                out.append(ids.tobytes())
                del ids[:]
        if apart:
            ends = np.flatnonzero(np.frombuffer(ids, id_dtype(size)) == spec["model"]["vocab"][shown[apart]]) * ids.itemsize
            data, at = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(data[at:end])
                at = end + ids.itemsize
        return out

    def encode(runs: list[str]) -> list[bytes]:
        words, near, far = [], [], {}
        for run in runs:
            if word(run):  # a pre-token by itself
                words.append(run)
            elif run not in marks and simple(run):
                near.append(run)
            elif run not in marks:
                far[run] = pieces(run)
        found = pieces("\n".join([*near, ""]))  # a line feed behind each is a pre-token by itself
        new = list(set(words).union(found, *far.values()))
        made = dict(zip(new, merge(new)))
        at, whole = 0, dict(marks)
        for run in near:
            end = found.index("\n", at)
            whole[run] = b"".join([made[x] for x in found[at:end]])
            at = end + 1
        whole.update((run, b"".join([made[x] for x in cut])) for run, cut in far.items())
        return [whole[run] if run in whole else made[run] for run in runs]

    return RunEncoder(split, encode, id_dtype(size), plain)
