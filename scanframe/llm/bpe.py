"""Byte-level BPE encoding and decoding with a given vocabulary, merged by a contiguous rank array."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType

from scanframe.llm.common import blocks

VOCABULARY = "byte_bpe_50k.json"
_NONE = 1 << 30  # rank of a pair that never merges

# fixed values: how the vocabulary's pre-tokenizer splits a text
_SPACE = r"\t-\r \x85\xa0  -     　"
_SPLIT = regex.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
# the same for texts of ASCII and Latin letters, in the faster standard engine
_PLAIN = re.compile("[^\t\n\r -~À-ɏ]")
_SPLIT_PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Default place of the vocabulary: the folder in BPE_VOCABULARIES, else the installed public files."""
    folder = os.environ.get("BPE_VOCABULARIES")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as code points from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass(frozen=True)
class Vocabulary:
    """Fixed-size tables of a byte-level BPE: what tasks get. Its size does not depend on the data."""

    tokens: list[bytes]  # by id
    byte_ids: np.ndarray  # id of each single byte
    keys: np.ndarray  # sorted pairs, left id * size + right id
    ranks: np.ndarray
    merged: np.ndarray  # id of the merged pair
    special: dict[str, int]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file whose model is a byte-level BPE without normalizer, prefix space or word ends."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError("not a plain byte-level BPE")
    if spec["pre_tokenizer"]["add_prefix_space"] or model["continuing_subword_prefix"] or model["end_of_word_suffix"]:
        raise ValueError("prefixes and word ends are not supported")
    of_char, ids = _byte_of_char(), model["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max([*ids.values(), *special.values()]) + 1
    tokens = [b""] * size
    for word, i in ids.items():
        tokens[i] = bytes(of_char[c] for c in word)
    for word, i in special.items():
        tokens[i] = word.encode()
    byte_ids = np.array([ids[c] for c, _ in sorted(of_char.items(), key=lambda x: x[1])], np.int64)
    pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
    keys = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    return Vocabulary(
        tokens, byte_ids, keys[order], np.arange(len(pairs), dtype=np.int64)[order],
        np.array([ids[a + b] for a, b in pairs], np.int64)[order], special)


class Encoder:
    """Encodes words; keeps a bounded number of them, then starts afresh. Results do not depend on what is kept."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 300_000):
        self.v, self.keep = vocabulary, keep
        self.size = len(vocabulary.tokens)
        self._forget()
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair of ids; pairs with an id below 0 never merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.v.keys, key), len(self.v.keys) - 1)
        hit = (self.v.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.v.ranks[at], _NONE), np.where(hit, self.v.merged[at], -1)

    def _merged(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of one length, one row each: parts and adjacent ranks lie contiguously.

        Each step takes the smallest adjacent rank of every word, deletes the boundary under it
        by moving the rest of the row up, and refreshes the two neighbouring ranks.
        """
        width = len(words[0])
        parts = self.v.byte_ids[np.frombuffer(b"".join(words), np.uint8).reshape(-1, width)]
        out: list[np.ndarray] = [None] * len(words)
        rows = np.arange(len(words))
        parts = np.pad(parts, ((0, 0), (0, 2)), constant_values=-1)
        ranks, ids = self._pair_ranks(parts[:, :-1], parts[:, 1:])
        length = np.full(len(words), width)
        while len(rows):
            at = ranks.argmin(axis=1)
            line = np.arange(len(rows))
            done = ranks[line, at] == _NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[rows[k]] = parts[k, :length[k]].astype(np.uint32)
                go = ~done
                rows, parts, ranks, ids, length, at = (x[go] for x in (rows, parts, ranks, ids, length, at))
                if not len(rows):
                    break
                line = np.arange(len(rows))
            new = ids[line, at]
            column = np.arange(parts.shape[1] - 1)
            moved = column[None, :] > at[:, None]
            parts[:, :-1] = np.where(moved, parts[:, 1:], parts[:, :-1])
            parts[line, at] = new
            last = ranks.shape[1] - 1
            shift = moved[:, :last]
            ranks[:, :-1] = np.where(shift, ranks[:, 1:], ranks[:, :-1])
            ids[:, :-1] = np.where(shift, ids[:, 1:], ids[:, :-1])
            length -= 1
            ranks[line, at], ids[line, at] = self._pair_ranks(new, parts[line, at + 1])
            before = np.maximum(at - 1, 0)
            rank, merged = self._pair_ranks(parts[line, before], new)
            inner = at > 0
            ranks[line, before] = np.where(inner, rank, ranks[line, before])
            ids[line, before] = np.where(inner, merged, ids[line, before])
        return out

    def _long(self, word: bytes) -> np.ndarray:
        """The same for one long word with a heap of ranks, as scanning it again and again is quadratic."""
        import heapq

        parts = self.v.byte_ids[np.frombuffer(word, np.uint8)]
        ranks, merged = self._pair_ranks(parts[:-1], parts[1:])
        ids = parts.tolist()
        n = len(ids)
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1], m) for i, (r, m) in enumerate(zip(ranks.tolist(), merged.tolist(), strict=True)) if r < _NONE]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            key = ids[i] * self.size + ids[j]
            at = int(np.searchsorted(self.v.keys, key))
            if at < len(self.v.keys) and self.v.keys[at] == key:
                heapq.heappush(heap, (int(self.v.ranks[at]), i, ids[i], ids[j], int(self.v.merged[at])))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = m, -1, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
                push(i, nxt[j])
            if prv[i] >= 0:
                push(prv[i], i)
        return np.array([x for x in ids if x >= 0], np.uint32)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # word: place in ``begins``
        self.flat, self.begins = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not known yet, by length, in blocks of bounded size."""
        by_length: dict[int, list[bytes]] = {}
        for w in words.difference(self.known):
            raw = w.encode()
            by_length.setdefault(len(raw), []).append(raw)
        found: list[np.ndarray] = []
        for width, group in by_length.items():
            for raw in group:
                self.known[raw.decode()] = len(self.known)
            if width == 1:
                found.extend(self.v.byte_ids[np.frombuffer(raw, np.uint8)] for raw in group)
            elif width > 64:
                found.extend(map(self._long, group))
            else:
                step = max(1, 400_000 // width)
                for k in range(0, len(group), step):
                    found.extend(self._merged(group[k:k + step]))
        if found:
            self.flat = np.concatenate([self.flat, *found], dtype=np.uint32, casting="unsafe")
            ends = self.begins[-1] + np.cumsum([len(x) for x in found])
            self.begins = np.concatenate([self.begins, ends])

    def _gathered(self, words: list[str]) -> np.ndarray:
        """The ids of known words one after another."""
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        begin, size = self.begins[at], self.begins[at + 1] - self.begins[at]
        ends = np.cumsum(size)
        if not len(ends):
            return np.empty(0, np.uint32)
        return self.flat[np.arange(ends[-1]) + np.repeat(begin - ends + size, size)]

    def words(self, text: str) -> list[str]:
        return _SPLIT.findall(text) if _PLAIN.search(text) else _SPLIT_PLAIN.findall(text)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; strings of special tokens inside become those tokens. New words are learned together."""
        pieces = [self.special.split(t) if self.special else [t] for t in texts]
        split = [[self.words(p) if k % 2 == 0 else p for k, p in enumerate(ps)] for ps in pieces]
        wanted = {w for ps in split for p in ps[::2] for w in p}
        if len(self.known) + len(wanted) > self.keep:
            self._forget()
        self.learn(wanted)
        return [np.concatenate([
            np.array([self.v.special[p]], np.uint32) if k % 2 else self._gathered(p) for k, p in enumerate(ps)]) for ps in split]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.v.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _encoder(spark: SparkSession, path: str | None):
    """The vocabulary goes to the tasks as a broadcast: 50 thousand tokens whatever the data."""
    held = spark.sparkContext.broadcast(load_vocabulary(path or vocabulary_path()))
    return lambda: Encoder(held.value)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of the documents plus ``ids`` (array<int>) and ``decoded`` (the ids read back as text).

    Null text encodes as empty; special token strings inside texts become their tokens. Columns
    of the input stay as they are: where one has a new column's name (in any case of letters),
    the new one gets underscores after it until it is unlike all others. Each text is encoded
    whole, in its own task, without a shuffle.
    """
    make = _encoder(docs.sparkSession, path)
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        return free(name + "_") if name in taken else name

    schema = docs.select("*").schema.add(free("ids"), ArrayType(IntegerType())).add(free("decoded"), "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in blocks(batches, lambda b: b.column("text")):
            ids = encoder.encode_all([t or "" for t in batch.column("text").to_pylist()])
            offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32))),
                pa.array([encoder.decode(x) for x in ids], pa.string())], schema.names)

    return docs.mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit integers), decoded_sha256."""
    make = _encoder(docs.sparkSession, path)
    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in blocks(batches, lambda b: b.column("text")):
            ids = encoder.encode_all([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(map(len, ids), pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
