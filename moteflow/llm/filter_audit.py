"""How filters interact: which of them removes what in every order, with exact copies found by radix tries of texts.

Five filters look at a whole text (null: empty; words are maximal runs without ASCII white space, case-sensitive). A row fails
A with under 200 words, B where 100 * distinct words < 50 * words, C where 100 * capitals A-Z > 2 * code points, D where the text
holds any of ``#$%&*|``, E where a row with a smaller doc_id has the same text.

Exact copies. Each task inserts the texts of a batch into a compressed trie; a terminal holds the smallest id of its text, so a mass of
copies leaves a batch as one row. These rows are range-partitioned by adaptive prefixes: the key is the text's first 16, next 48 and next 192 bytes
and then a hash of all, and a range boundary reads no deeper than it must to part a crowded prefix; equal texts have equal keys and meet in one
partition. There they are sorted and inserted into tries again, and the traversal gives the first document of each distinct text. A trie
is emptied when it holds ``TRIE_BYTES`` and the key changes, so memory does not grow with the partition.

What is left are small rows: every row counts as a copy, firsts are taken off that count. They meet the labels by id and are
summed to counts by (part, mask of failed filters), from which each order and step is read.

Nulls and ties: a null text is the empty text; a null part is the empty string; a null id is no smaller id, never a copy, and has no label. Rows that
repeat the id of a text's first document are firsts too (no id is smaller), whatever their parts. Several labels of one id: it is good, or toxic, if any of them
says so. Columns besides those named are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from moteflow.llm.common import UPPER, shards, utf8

#: The filters by letter; bit i of a mask is set where a row fails letter i.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
TRIE_BYTES = 64_000_000
_CUTS = (16, 64, 256)
_TAIL_BYTES, _MARKS = bytes(range(128, 192)), b"#$%&*|"


def failed(text: bytes) -> int:
    """Mask of the filters A to D that a text fails."""
    words = text.split()
    size = len(text)
    capitals, points = size - len(text.translate(None, UPPER)), len(text.translate(None, _TAIL_BYTES))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * points) << 2 | (len(text.translate(None, _MARKS)) < size) << 3


class RadixTrie:
    """Compressed trie of byte strings. A node is [label, children by first byte, value]; only terminals have a value."""

    def __init__(self):
        self.root, self.bytes = [b"", {}, None], 0

    def terminal(self, text: bytes) -> list:
        """The node at which ``text`` ends; made if it is new."""
        node, at, size = self.root, 0, len(text)
        while at < size:
            child = node[1].get(text[at])
            if child is None:
                self.bytes += size - at
                leaf = node[1][text[at]] = [text[at:], {}, None]
                return leaf
            label = child[0]
            if not text.startswith(label, at):
                k = _shared(label, text, at)
                child[0] = label[k:]
                child = node[1][text[at]] = [label[:k], {label[k]: child}, None]
            node, at = child, at + len(child[0])
        return node

    def values(self) -> Iterator:
        """The values of all terminals."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[2] is not None:
                yield node[2]
            stack.extend(node[1].values())


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``text[at:]``."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == text[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _insert(trie: RadixTrie, text: bytes, doc: int, part: str, n: int, row) -> None:
    """Keep at the text's terminal the smallest id, how often each part has it, and the ``row`` it came with."""
    node = trie.terminal(text)
    held = node[2]
    if held is None or doc < held[0]:
        node[2] = (doc, {part: n}, row)
    elif doc == held[0]:
        held[1][part] = held[1].get(part, 0) + n


_FIRSTS = "doc_id long, part string, mask int, n long"


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first documents of a batch's distinct texts, with the keys that range partitioning looks at."""
    for shard in shards(batches, "text"):
        texts, trie = utf8(shard["text"]), RadixTrie()
        for i, (doc, part) in enumerate(zip(shard["doc_id"].to_pylist(), shard["part"].to_pylist(), strict=True)):
            _insert(trie, texts[i], doc, part, 1, i)
        rows = [(doc, part, failed(texts[i]), n, i) for doc, parts, i in trie.values() for part, n in parts.items()]
        doc, part, mask, n, at = zip(*rows, strict=True) if rows else ((),) * 5
        edges = list(zip((0, *_CUTS), _CUTS, strict=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(part, pa.string()), pa.array(mask, pa.int32()), pa.array(n, pa.int64()),
             *[pa.array([texts[i][a:b] for i in at], pa.binary()) for a, b in edges],
             pa.array([xxhash.xxh3_64_intdigest(texts[i]) - 2**63 for i in at], pa.int64()), pa.array([texts[i] for i in at], pa.binary())],
            ["doc_id", "part", "mask", "n", *[f"k{i}" for i in range(len(edges))], "k", "text"])


def _global(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first documents of the distinct texts of a sorted partition."""
    def emptied(trie):
        rows = [(doc, part, mask, n) for doc, parts, mask in trie.values() for part, n in parts.items()]
        cols = zip(*rows, strict=True) if rows else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "part", "mask", "n"])

    trie, last = RadixTrie(), None
    for shard in shards(batches, "text"):
        columns = [shard[c].to_pylist() for c in ("doc_id", "part", "n", "mask", "k0", "k", "text")]
        for doc, part, n, mask, head, k, text in zip(*columns, strict=True):
            if trie.bytes > TRIE_BYTES and (head, k) != last:
                yield emptied(trie)
                trie = RadixTrie()
            _insert(trie, text, doc, part, n, mask)
            last = (head, k)
    yield emptied(trie)


def first_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): the documents whose text no smaller id has, the filters A to D they fail, and their rows."""
    local = docs.where("doc_id IS NOT NULL").mapInArrow(_local, f"{_FIRSTS}, k0 binary, k1 binary, k2 binary, k long, text binary")
    keys = ["k0", "k1", "k2", "k"]
    return local.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "part", "n", "mask", "k0", "k", "text").mapInArrow(_global, _FIRSTS)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in shards(batches, "text"):
        yield pa.RecordBatch.from_arrays([shard["doc_id"], shard["part"], pa.array([failed(t) for t in utf8(shard["text"])], pa.int32()), pa.array([1] * shard.num_rows, pa.int64())],
                                         ["doc_id", "part", "mask", "n"])


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): rows of ``docs(doc_id, text, part)`` by the set of filters they fail, and how many of them ``labels(doc_id, quality, toxic)`` calls good and toxic."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    every = docs.mapInArrow(_marks, _FIRSTS).withColumn("mask", F.when(F.col("doc_id").isNull(), F.col("mask")).otherwise(F.col("mask").bitwiseOR(COPY)))
    sign = F.explode(F.array(F.struct(F.col("mask").alias("m"), F.col("n").alias("c")), F.struct(F.col("mask").bitwiseOR(COPY).alias("m"), (-F.col("n")).alias("c"))))
    firsts = first_documents(docs).select("doc_id", "part", sign.alias("s")).select("doc_id", "part", F.col("s.m").alias("mask"), F.col("s.c").alias("n"))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("is_good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("is_toxic"))
    return every.unionByName(firsts).join(said, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(f"is_{c}"), F.col("n")).otherwise(F.lit(0).cast("long"))).alias(c) for c in ("good", "toxic")])


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from the at most ``2 ** len(filters)`` counts of a part: rows kept after the step, removed by it,
    failing its filter but removed before, failing its filter only, removed rows that are good and toxic, and what its filter removes over all orders."""
    steps = [(("".join(order)), i + 1, 1 << filters.index(f), sum(1 << filters.index(g) for g in order[:i])) for order in permutations(filters) for i, f in enumerate(order)]
    orders = len(steps) // len(filters)
    plan = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"bit":{b},"before":{p}}}' for o, s, b, p in steps) + "]"), "array<struct<o string, s int, bit int, before int>>")
    total = lambda value, test: F.expr(f"aggregate(m, 0L, (t, x) -> t + if({test}, x.{value}, 0L))")
    fails, gone = "x.mask & step.bit <> 0", "x.mask & step.before"
    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m")).withColumn("step", F.explode(plan)).select(
        "part", F.col("step.o").alias("filter_order"), F.col("step.s").alias("step"),
        total("n", "x.mask & (step.bit | step.before) = 0").alias("kept"),
        total("n", f"{fails} AND {gone} = 0").alias("removed"),
        total("n", f"{fails} AND {gone} <> 0").alias("redundant"),
        total("n", "x.mask = step.bit").alias("unique_fails"),
        total("good", f"{fails} AND {gone} = 0").alias("good_lost"),
        total("toxic", f"{fails} AND {gone} = 0").alias("toxic_lost"),
        F.expr(f"aggregate(m, 0L, (t, x) -> t + if({fails}, CAST({orders} * x.n / bit_count(x.mask) AS BIGINT), 0L))").alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``interactions`` of the filters A to E over ``docs``, for each value of the column ``part``."""
    return interactions(mask_counts(docs, labels, part))
