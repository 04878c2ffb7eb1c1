"""Near-duplicate groups by an LSH forest over minhash signatures.

Documents with equal shingle sets collapse to the smallest id first, by a partial aggregation, so a mass of exact copies
is one row from there on. A tree of the forest is one order of the signature's components; its rows are sorted by them. A region is
the set of rows that share their first components; the depth adapts: a region of more than ``REGION`` rows is cut
one step of ``LADDER`` deeper, where near-identical texts stay together and others part.

Candidates come in two steps. First each row is paired with its longest-common-prefix neighbour in the region's order and
with the region's smallest id. Candidates whose signatures agree in too few components are left out (the margin
is over five standard deviations below the threshold), the rest is confirmed on the full shingle sets, and links give components.
Then, in regions of up to ``REGION`` rows, all pairs of rows that are still in different components are candidates: pairs
within one component could add nothing. So a pair whose first labels agree in a tree is compared there, whatever its similarity, unless that
region was crowded and had to be cut deeper.

Rows of a crowded region are joined exactly, so that neither the depth of a region nor the size of a group decides what is found.
All shingles have one order, the rare ones first. Two different sets over the threshold share at least ``need`` shingles, and the first they share stands
among the first ``n - need + 1`` of each. Shingles that stand in one component only are dropped by an aggregate before the join; pairs of rows of different
components that share one there are confirmed on the full sets, with no other filter. A pair that shares many meets at its first: each row knows the ``RECENT`` shingles before its own, and where
two rows have one of these in common they have met already. The forest only keeps this join small: rows it has linked are not
compared again. The order comes from counts over at most ``ORDERED`` shingles; any order gives the same pairs.

Null and empty texts and texts without words have empty sets: no links, a component of their own. Rows that repeat an id
and its text get the same result each; an id with several texts has the links of all of them. A null
id is no document to link: component null, not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from moteflow.llm.common import Flat, shards, utf8
from moteflow.llm.hashing import COMPONENTS, WordHashes, scramble, set_kernel, shingle_sets, signature_kernel
from moteflow.plans.graph import connected_components
from moteflow.session import cut, discard

TREES = 24
LADDER = (4, 6, 9, 12, 16)
REGION = 32
ORDERED = 8_000_000
FREQUENT = 500_000
RECENT = 8


def _tree(t: int) -> list[int]:
    """Component numbers of tree ``t``: the first steps of different trees share none."""
    return [(t + TREES * k if t + TREES * k < COMPONENTS else 7 * t + 11 * k) % COMPONENTS for k in range(LADDER[-1])]


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COMPONENTS)


def _forest(hashed: bool):
    """A row for each tree of each node: a hash of the first labels, or all labels as bytes in the tree's order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, nodes = _signatures(batch["signature"]), batch["node"]
            for t in range(TREES):
                part = np.ascontiguousarray(sig[:, _tree(t)[: LADDER[0] if hashed else LADDER[-1]]])
                if hashed:
                    h = np.zeros(len(part), np.uint64)
                    for k in range(LADDER[0]):
                        h = scramble(h + part[:, k] + np.uint64(k + 1))
                    value = pa.array(h.view(np.int64))
                else:
                    value = pa.array([x.tobytes() for x in part], pa.binary())
                yield pa.RecordBatch.from_arrays([nodes, pa.array(np.full(len(part), t, np.int32)), value], ["node", "tree", "h" if hashed else "labels"])
    return run


def _alike(least: int):
    """The candidates whose signatures agree in at least ``least`` components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_signatures(batch["sa"]) == _signatures(batch["sb"])).sum(axis=1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(same))
    return run


def regions(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, depth, prefix, labels, node, n): each row with partners in the shallowest region of at most REGION rows, or in the
    deepest; and (node): the rows of crowded regions, which had to be cut deeper in some tree.
    The first step works on hashes of the labels; rows without a partner leave before the labels are laid out."""
    rows = nodes.select("node", "signature").mapInArrow(_forest(True), "node long, tree int, h long")
    sizes = rows.groupBy("tree", "h").agg(F.count("*").alias("n")).where("n > 1")
    paired = cut(rows.join(sizes, ["tree", "h"]).select("tree", "node", "n"))
    active = nodes.join(paired.select("node").distinct(), "node", "left_semi")
    labels = active.select("node", "signature").mapInArrow(_forest(False), "node long, tree int, labels binary")
    here = cut(labels.join(paired, ["tree", "node"]).withColumn("depth", F.lit(LADDER[0])).withColumn("prefix", F.expr(f"substring(labels, 1, {4 * LADDER[0]})")))
    out = here.where(F.col("n") <= REGION)
    for depth in LADDER[1:]:
        rows = here.where(F.col("n") > REGION).select("tree", "labels", "node").withColumn("depth", F.lit(depth)).withColumn("prefix", F.expr(f"substring(labels, 1, {4 * depth})"))
        sizes = rows.groupBy("tree", "prefix").agg(F.count("*").alias("n")).where("n > 1")
        here = cut(rows.join(sizes, ["tree", "prefix"]))
        out = out.unionByName(here if depth == LADDER[-1] else here.where(F.col("n") <= REGION))
    return out, paired.where(F.col("n") > REGION).select("node").distinct()


def _first_pairs(region: DataFrame) -> DataFrame:
    key = Window.partitionBy("tree", "depth", "prefix")
    near = region.select("node", F.lag("node").over(key.orderBy("labels", "node")).alias("other"))
    pivot = region.groupBy("tree", "depth", "prefix").agg(F.min("node").alias("other"))
    star = region.join(pivot, ["tree", "depth", "prefix"]).select("node", "other")
    return _pairs(near.unionByName(star))


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and signatures let reach ``percent``."""
    s = percent / 100
    least = int(COMPONENTS * max(0.0, s - 5.5 * (s * (1 - s) / COMPONENTS) ** 0.5))
    side = nodes.select("node", "n_shingles", "signature")
    return pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b") \
        .where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)") \
        .select("a", "b", "sa", "sb").mapInArrow(_alike(least), "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach ``percent`` of their union."""
    both = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b") \
        .withColumn("i", F.size(F.array_intersect("xa", "xb")))
    return both.where(f"100 * i >= {percent} * (size(xa) + size(xb) - i)").select("a", "b").distinct()


def _sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    texts = docs.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text")
    return texts.mapInArrow(set_kernel(width), "node long, shingles array<long>")


_PREFIX = "token long, node long, component long, n long, at long, before array<long>"


def _prefixes(width: int, percent: int, frequent: Broadcast):
    """(token, node, component, n, at, before): the first shingles of each set in the common order, with the set's size, the shingle's place and the shingles just before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (known, times) = WordHashes(), frequent.value
        for shard in shards(batches, "text", 8_000_000):
            token, sizes = [], []
            for s in shingle_sets(utf8(shard["text"]), width, memo):
                if len(known) and len(s):
                    k = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[k] == s, times[k], 0), kind="stable")]
                token.append(s[: len(s) + len(s) * -percent // 100 + 1])
                sizes.append(len(s))
            flat = Flat(np.array([len(x) for x in token]))
            row = np.repeat(np.arange(len(token)), flat.sizes)
            at = np.arange(len(row)) - np.repeat(flat.starts, flat.sizes)
            values = np.concatenate(token).view(np.int64) if token else np.zeros(0, np.int64)
            back = np.arange(-RECENT, 0)
            real = at[:, None] + back >= 0
            before = values[(np.arange(len(row))[:, None] + back)[real]]
            ends = np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(values), shard["node"].take(pa.array(row)), shard["component"].take(pa.array(row)), pa.array(np.array(sizes, np.int64)[row]), pa.array(at.astype(np.int64)),
                                              pa.ListArray.from_arrays(pa.array(ends), pa.array(before))], ["token", "node", "component", "n", "at", "before"])
    return run


def _frequent(docs: DataFrame, nodes: DataFrame, width: int) -> Broadcast:
    """Shingles of more than one set with their counts, from the sets with the smallest hashes of the id."""
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(1_000_000 * min(1, ORDERED / max(total, 1))))
    counts = _sets_of(docs, some, width).select(F.explode("shingles").alias("token")).groupBy("token").count().where("count > 1")
    top = counts.orderBy(F.desc("count"), "token").limit(FREQUENT).toArrow()  # at most FREQUENT rows
    token, times = top["token"].to_numpy().view(np.uint64), top["count"].to_numpy()
    order = np.argsort(token)
    return docs.sparkSession.sparkContext.broadcast((token[order], times[order]))


def apart_pairs(docs: DataFrame, nodes: DataFrame, links: DataFrame, width: int, percent: int) -> DataFrame:
    """Every pair (a, b) of ``nodes(node, n_shingles)`` in different components of ``links`` that may reach ``percent``."""
    label = nodes.select("node").distinct().join(connected_components(links, "a", "b"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    texts = docs.join(label.withColumnRenamed("node", "doc_id"), "doc_id").select(F.col("doc_id").alias("node"), "component", "text")
    every = cut(texts.mapInArrow(_prefixes(width, percent, _frequent(docs, nodes, width)), _PREFIX))
    spanning = every.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    rows = cut(every.join(spanning, "token", "left_semi"))
    discard(every)
    other = rows.toDF("token", "other", "oc", "on", "oat", "obefore")
    need = f"CAST(ceil({percent} * (n + on) / {100 + percent}) AS BIGINT)"
    shared = rows.join(other, "token").where("component < oc").where(f"100 * least(n, on) >= {percent} * greatest(n, on) AND {need} <= least(n, on) - CAST(n = on AS INT)") \
        .where(f"least(n - at, on - oat) >= {need}").where("NOT arrays_overlap(before, obefore)")
    return _pairs(shared.select("node", "other"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``: texts are linked when at least ``percent``
    of the union of their ``width``-word shingle sets is shared; a component's id is its smallest doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(docs.mapInArrow(signature_kernel(width), "doc_id long, n_shingles long, set_a long, set_b long, signature binary"))
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"))
    member = cut(full.select("doc_id", "set_a", "set_b").join(first, ["set_a", "set_b"]).where("doc_id <> node").select("doc_id", "node").distinct())
    own = first.withColumnRenamed("node", "doc_id")
    nodes = cut(full.join(own, ["set_a", "set_b", "doc_id"]).dropDuplicates(["set_a", "set_b"]).select(F.col("doc_id").alias("node"), "n_shingles", "signature"))
    region, crowd = regions(nodes)
    region, crowd = cut(region), nodes.join(crowd, "node", "left_semi")
    sets = cut(_sets_of(docs, region.select("node").unionByName(crowd.select("node")), width))
    first_links = cut(confirmed(likely(_first_pairs(region), nodes, percent), sets, percent))
    small = region.where(F.col("n") <= REGION).select("tree", "depth", "prefix", "node")
    placed = cut(small.join(connected_components(first_links, "a", "b"), "node", "left").withColumn("component", F.coalesce("component", "node")))
    mixed = placed.groupBy("tree", "depth", "prefix").agg((F.min("component") != F.max("component")).alias("m")).where("m").drop("m")
    open_ = placed.join(mixed, ["tree", "depth", "prefix"])
    other = open_.select("tree", "depth", "prefix", F.col("node").alias("other"), F.col("component").alias("oc"))
    pairs = _pairs(open_.join(other, ["tree", "depth", "prefix"]).where("node < other AND component <> oc").select("node", "other"))
    forest_links = cut(first_links.unionByName(confirmed(likely(pairs, nodes, percent), sets, percent)))
    apart = cut(apart_pairs(docs, crowd, forest_links, width, percent))
    links = cut(forest_links.unionByName(confirmed(apart, sets, percent)))
    discard(region, sets, first_links, placed, forest_links, apart)
    edges = links.unionByName(member.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    label = connected_components(edges, "a", "b").withColumnRenamed("node", "doc_id")
    return signed.select("doc_id", "n_shingles").join(label, "doc_id", "left") \
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)))
