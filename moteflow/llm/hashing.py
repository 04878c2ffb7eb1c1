"""Word and shingle hashes of texts, minhash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from moteflow.llm.common import LOWER, Flat, shards, utf8

#: Components of a signature.
COMPONENTS = 128
_RANDOM = np.random.default_rng(20240229)
_FLIP = _RANDOM.integers(0, 2**32, COMPONENTS, dtype=np.uint32)
_TIMES = _RANDOM.integers(0, 2**31, COMPONENTS, dtype=np.uint32) * 2 + 1
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


class WordHashes(dict):
    """Memo of 64-bit word hashes; emptied when it gets large."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], width: int, memo: WordHashes) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the runs of ``width`` words of each text, A-Z in small letters; a shorter text's whole
    word sequence is one. No words: empty."""
    words = [[] if t is None else t.translate(LOWER).split() for t in texts]
    flat = Flat(np.array([len(w) for w in words]))
    h = memo.of([x for w in words for x in w])
    rolled = np.zeros(len(h), np.uint64)
    for k in range(width):
        rolled[: len(h) - k] = scramble(rolled[: len(h) - k] + h[k:] * _MIX[0] + np.uint64(k))
    for start, size in zip(flat.starts, flat.sizes, strict=True):
        if size >= width:
            yield np.unique(rolled[start : start + size - width + 1])
        elif size:
            one = np.array([size], np.uint64)
            for x in h[start : start + size]:
                one = scramble(one * _MIX[0] + x)
            yield one
        else:
            yield np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minhash components of a set; the hashes are taken in pieces so that a very long text needs no large matrix."""
    low = (hashes >> np.uint64(16)).astype(np.uint32)
    out = np.full(COMPONENTS, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 512):
        np.minimum(out, ((low[i : i + 512, None] ^ _FLIP) * _TIMES).min(axis=0), out=out)
    return out


def signature_kernel(width: int):
    """(doc_id, n_shingles, set_a, set_b, signature) of each document; set_a and set_b are 128 bits of the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for shard in shards(batches, "text", 8_000_000):
            n, a, b, sig = [], [], [], []
            for s in shingle_sets(utf8(shard["text"]), width, memo):
                raw = s.tobytes()
                n.append(len(s))
                both = xxhash.xxh3_128_digest(raw)
                a.append(int.from_bytes(both[:8], "big", signed=True))
                b.append(int.from_bytes(both[8:], "big", signed=True))
                sig.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays([shard["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sig, pa.binary())],
                                             ["doc_id", "n_shingles", "set_a", "set_b", "signature"])
    return run


def set_kernel(width: int):
    """(node, shingles) of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for shard in shards(batches, "text", 8_000_000):
            sets = [s.view(np.int64) for s in shingle_sets(utf8(shard["text"]), width, memo)]
            sizes = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([shard["node"], pa.ListArray.from_arrays(pa.array(sizes), flat)], ["node", "shingles"])
    return run
