"""Phrases whose words stand together more often than their parts suggest, from a weighted de Bruijn graph of words.

A piece is what lies between two of ``.,;:!?`` and line ends. Every word begins exactly one edge of ``longest`` words, filled up with an end
mark where the piece ends, so the edges' weights sum to the number of words. Edges join overlapping nodes of ``longest - 1`` words. Only
edges are counted in the corpus; a shorter phrase's count is the flow out of it: the edges that begin with it, those into the end mark (the piece-end
correction) among them.

Spark does this in two steps. A task counts the edges of some megabytes of text and lays them out as lines in one value for each (lang, bucket), where
the bucket comes from an edge's first two words; a bucket's values meet in one group, which sums the edges and reads the flows of all prefixes off
their sorted order. The number of buckets grows with the text (``BUCKET_BYTES`` each). Pairs with over ``HOT`` of a sample's words are dealt out by their third word as well
and their flows are summed by Spark; the sample changes who does the work and no result. Single words lie in many buckets and are summed by Spark.

Unary paths: where all flow of a node runs through one edge into a node that has no other, both and all nodes along such a chain have the chain's one
count. ``compact_paths`` joins them by pointer doubling; every phrase inside such a path other than its edges is part of a longer candidate as frequent as itself.

A word is a run without spaces and tabs within a piece, A-Z in small letters. Null texts are empty, a null lang is ``und``; rows that repeat are counted as
often as they stand; other columns are not read; no rows give no phrases. Texts are cut at piece ends into windows of ``WINDOW_BYTES``, so that a very long text needs no
more memory than short ones. Counts are exact at any size: words are compared as words, and scores are decimals of 38 digits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from moteflow.llm.common import UPPER, utf8
from moteflow.plans.graph import chain_heads
from moteflow.session import cut

WINDOW_BYTES = 8_000_000
BUCKET_BYTES = 64_000_000
SAMPLE_BYTES = 8_000_000
HOT = 0.002
PARTS = 16
#: The end mark is a character that no word holds; every character that ends a piece is turned into it.
END = b"."
_TABLE = bytearray(bytes.maketrans(UPPER, UPPER.lower()))
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = END[0]
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """Numbers of words in the order in which they come; the end mark is 0."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, text with end marks) of about WINDOW_BYTES, never cut within a piece."""
    held, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), utf8(batch["text"]), strict=True):
            text, start = (text or b"").translate(_TABLE), 0
            while start < len(text):
                stop = text.find(END, start + WINDOW_BYTES)
                stop = len(text) if stop < 0 else stop
                held.setdefault(lang, []).append(text[start:stop])
                size, start = size + stop - start, stop
                if size >= WINDOW_BYTES:
                    yield from ((k, END.join(v)) for k, v in held.items())
                    held, size = {}, 0
    yield from ((k, END.join(v)) for k, v in held.items())


def _summed(columns: list[np.ndarray], counts: np.ndarray | None, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of word numbers below ``size`` in their order, and how often they stand (or the sums of ``counts``)."""
    if size ** len(columns) < 2**63:
        packed = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            packed = packed * size + c
        order = None if counts is None else np.argsort(packed, kind="stable")
        packed = np.sort(packed) if order is None else packed[order]
        new = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)
        left, out = packed[new], []
        for _ in columns:
            out.insert(0, left % size)
            left = left // size
    else:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        new = np.flatnonzero(np.concatenate([[True], change])) if len(order) else np.zeros(0, np.int64)
        out = [c[new] for c in columns]
    if counts is None:
        return out, np.diff(np.append(new, len(columns[0])))
    return out, np.add.reduceat(counts[order], new) if len(new) else counts[:0]


def _edges(text: bytes, longest: int, ids: _Ids) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct edges of a window as columns of word numbers, with their weights."""
    mark = b" " + b" ".join([END] * (longest - 1)) + b" " if longest > 1 else b" "
    row = ids.of((text + END).replace(END, mark).split())
    n = len(row) - longest + 1
    begins = np.flatnonzero(row[:max(n, 0)])
    return _summed([row[begins + k] for k in range(longest)], None, len(ids))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, n): pairs of words that stand more than once in a window; b is null for the words of the window."""
    for lang, text in _windows(batches):
        ids = _Ids()
        (a, b), n = _edges(text, 2, ids)
        words, some = list(ids), np.flatnonzero((n > 1) & (b > 0))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(some) + 1), pa.string()), pa.array([*(words[i] for i in a[some]), b""], pa.binary()),
                                          pa.array([*(words[i] for i in b[some]), None], pa.binary()), pa.array([*n[some].tolist(), int(n.sum())], pa.int64())], ["lang", "a", "b", "n"])


def _hot_pairs(docs: DataFrame, total: int) -> set[tuple[str, bytes, bytes]]:
    """Pairs with at least HOT of the words of a sample; at most 1 / HOT of them."""
    some = docs.sample(min(1.0, SAMPLE_BYTES / max(total, 1)), 1).mapInArrow(_pairs, "lang string, a binary, b binary, n long")
    counts = cut(some.groupBy("lang", "a", "b").agg(F.sum("n").alias("n")))
    words = counts.where("b IS NULL").agg(F.sum("n")).first()[0] or 0
    return {(r.lang, bytes(r.a), bytes(r.b)) for r in counts.where((F.col("b").isNotNull()) & (F.col("n") >= max(1, HOT * words))).collect()}


def _deal(longest: int, buckets: int, hot: set):
    """(lang, bucket, edges): the edges of a window as lines of words and weight, one value for each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _windows(batches):
            ids = _Ids()
            columns, weights = _edges(text, longest, ids)
            if not len(weights):
                continue
            words = list(ids)
            hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
            mixed = (hashes[columns[0]] * _MIX) ^ hashes[columns[1]]
            spread = [ids[a] * len(ids) + ids[b] for k, a, b in hot if k == lang and a in ids and b in ids]
            if spread and longest > 2:
                third = np.isin(columns[0] * len(ids) + columns[1], spread)
                mixed[third] ^= hashes[columns[2][third]] << np.uint64(20)
            mixed *= _MIX
            bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, values = bucket[order], pa.array(words, pa.binary())
            kinds, kind = np.unique(weights[order], return_inverse=True)
            ends = pa.array([b"%d\n" % k for k in kinds], pa.binary())
            lines = pc.binary_join_element_wise(*[values.take(pa.array(c[order])) for c in columns], ends.take(pa.array(kind)), b" ")
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset :][np.append(starts, len(bucket))]
            blobs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.ascontiguousarray(offsets)), lines.buffers()[2]])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(starts), pa.string()), pa.array(bucket[starts]), blobs], ["lang", "bucket", "edges"])
    return run


_GRAMS = "lang string, k int, phrase string, f long"


def _flows(longest: int, least: int, hot: set):
    """(lang, k, phrase, f) of a bucket: its phrases of two and more words with ``least`` or more, and partial counts of single words and hot pairs."""
    def run(group: pa.Table) -> pa.Table:
        lang, ids, parts, weights = group["lang"][0].as_py(), _Ids(), [], []
        for blob in group["edges"]:
            tokens = blob.as_py().split()
            weights.append(np.array(tokens[longest :: longest + 1], "S20").astype(np.int64))
            del tokens[longest :: longest + 1]
            parts.append(ids.of(tokens).reshape(-1, longest).astype(np.int32 if len(ids) < 2**31 else np.int64))
        rows = np.concatenate(parts)
        columns, counts = _summed([rows[:, k].astype(np.int64) for k in range(longest)], np.concatenate(weights), len(ids))
        words = list(ids)
        spread = [ids[a] * len(ids) + ids[b] for k, a, b in hot if k == lang and a in ids and b in ids]
        change, out = np.zeros(max(len(counts) - 1, 0), bool), ([], [], [])
        for k in range(1, longest + 1):
            change |= columns[k - 1][1:] != columns[k - 1][:-1]
            first = np.flatnonzero(np.concatenate([[True], change]))
            flow = np.add.reduceat(counts, first)
            keep = columns[k - 1][first] > 0
            if k > 1:
                keep &= (flow >= least) | (np.isin(columns[0][first] * len(ids) + columns[1][first], spread) if k == 2 and spread else False)
            chosen = first[keep]
            named = [[words[i] for i in columns[j][chosen]] for j in range(k)]
            out[0].extend([k] * len(chosen))
            out[1].extend(named[0] if k == 1 else map(b" ".join, zip(*named, strict=True)))
            out[2].extend(flow[keep].tolist())
        return pa.table([pa.array([lang] * len(out[0]), pa.string()), pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()).cast(pa.string()), pa.array(out[2], pa.int64())], ["lang", "k", "phrase", "f"])
    return run


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """(lang, k, phrase, f): how often each phrase of two to ``longest`` words stands within pieces of ``docs(text, lang)``, where that is ``least`` or more, and each single word."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shuffle = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = _hot_pairs(docs, total) if longest > 1 else set()
    buckets = max(2 * shuffle, -(-total // BUCKET_BYTES))
    dealt = docs.mapInArrow(_deal(longest, buckets, hot), "lang string, bucket int, edges binary")
    parts = dealt.groupBy("lang", "bucket").applyInArrow(_flows(longest, least, hot), _GRAMS)
    return parts.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("k") == 1) | (F.col("f") >= least))


def _head(k: str, n: str) -> F.Column:
    return F.expr(f"substring_index({k}, ' ', {n})")


def compact_paths(grams: DataFrame, longest: int = 3) -> DataFrame:
    """(lang, node, f, path, path_words): the nodes of ``longest - 1`` words on a unary path of two or more nodes, their count, the path's first node and its length in words.
    A link is an edge that carries all flow of both its nodes; more edges at either would take some, so links form chains."""
    node = grams.where(F.col("k") == longest - 1).select("lang", F.col("phrase").alias("node"), "f")
    edge = grams.where(F.col("k") == longest).select("lang", "f", _head("phrase", str(longest - 1)).alias("u"), _head("phrase", str(1 - longest)).alias("v"))
    links = edge.where("u <> v").join(node.withColumnRenamed("node", "u"), ["lang", "u", "f"], "left_semi").join(node.withColumnRenamed("node", "v"), ["lang", "v", "f"], "left_semi")
    links = cut(links.select(F.struct("lang", F.col("u").alias("node")).alias("prev"), F.struct("lang", F.col("v").alias("node")).alias("next"), "f"))
    nodes = links.select(F.explode(F.array("prev", "next")).alias("node"), "f").distinct()
    heads = cut(chain_heads(nodes, links).join(nodes, "node"))
    sizes = heads.groupBy("head").agg((F.count("*") + longest - 2).alias("path_words"))
    return heads.join(sizes, "head").select(F.col("node.lang").alias("lang"), F.col("node.node").alias("node"), "f", F.col("head.node").alias("path"), "path_words")


def mine_collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, path_words): each lang's ``top`` phrases of two to ``longest`` words that stand ``least`` times or more. ``a`` is the phrase's
    count, ``l`` and ``r`` those of the two parts of its lowest-scoring cut, the score ``1000000 * a * a / (l * r)``; phrases inside a longer
    candidate with ``share`` percent of their count are left out. Ties go to the higher count, then to the smaller phrase. ``path_words`` is
    the length of the unary path that a phrase is a node or an edge of, otherwise its own."""
    grams = cut(phrase_counts(docs, longest, least))
    total = grams.where("k = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = grams.where(F.col("f") >= least)
    part = frequent.select("lang", "phrase", "f")
    paths = cut(compact_paths(grams, longest))
    within = frequent.where("k > 2").select("lang", F.explode(F.array(_head("phrase", "k - 1"), _head("phrase", "1 - k"))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("m"))
    open_ = frequent.where("k > 1").join(within, ["lang", "phrase"], "left").where(F.col("m").isNull() | (100 * F.col("m").cast("decimal(38,0)") < share * F.col("f").cast("decimal(38,0)")))
    cuts = open_.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select("lang", "k", "phrase", F.col("f").alias("a"), "c", _head("phrase", "c").alias("lp"), _head("phrase", "c - k").alias("rp"))
    scored = cuts.join(part.toDF("lang", "lp", "l"), ["lang", "lp"]).join(part.toDF("lang", "rp", "r"), ["lang", "rp"]) \
        .withColumn("score", F.expr("CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))"))
    best = scored.groupBy("lang", "k", "phrase", "a").agg(F.min(F.struct("score", "c", "l", "r")).alias("b"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    ranked = best.select("lang", "k", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score")) \
        .withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    # the first of each part of a lang, then the first of these: no task sees more than PARTS * top phrases of a lang
    first = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("part")
    ends = ranked.withColumn("u", _head("phrase", str(longest - 1))).withColumn("v", _head("phrase", str(1 - longest)))
    at = ends.join(paths.toDF("lang", "u", "a", "path", "path_words"), ["lang", "u", "a"], "left") \
        .join(paths.select("lang", F.col("node").alias("v"), F.col("path").alias("vp")), ["lang", "v"], "left")
    return at.join(F.broadcast(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score",
                                                      F.coalesce(F.when(F.col("path") == F.col("vp"), F.col("path_words")), F.col("k")).cast("long").alias("path_words"))
