"""Line dedup: later copies of repeated runs of lines are deleted.

A document is the sequence of its lines that hold a word. The first copy of a run is the one with the smallest (doc_id,
position); a line is deleted when it lies in a run of lines with at least ``MIN_WORDS`` words together that also starts at
an earlier position. Runs stay within documents.

Lines are ranked in a suffix order by doubling: rank 0 orders the distinct lines, and rank k + 1 orders the pairs of rank
k at a position and 2**k lines on, so it orders all runs of 2**(k+1) lines. Only names that occur twice or more are
ranked and kept, so positions without a partner leave round by round. An interval of suffixes with a common prefix of any
length is named by two ranks that overlap. It suffices to look at two kinds of prefixes: for each line the
shortest run from it that reaches ``MIN_WORDS``, and the shortest such run up to it. Every maximal repeated run of enough
words is the union of such runs inside it (the runs that start at its lines cover all but a tail, and the one that
ends with it covers that), all of which repeat where it does. Each interval keeps its earliest suffix. As a line has a word at
least, log2(MIN_WORDS) rounds do, whatever the size of the corpus.

Names that a third of all lines share collapse by partial aggregation; joins that give names back can be split by Spark.

Lines compare as they are, byte by byte. Null and empty texts and blank lines have no lines to delete and stay. Rows that
repeat id and text are one document and stay alike; null ids come last in the order. Columns named ``lines_seen`` or ``lines_removed`` are replaced, all
others are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from moteflow.llm.common import columns_schema, fresh_name, shards, utf8
from moteflow.session import cut

MIN_WORDS = 50
AT = ["d", "t"]


def _lines(min_words: int):
    """(d, t, p, ha, hb, ahead, back) of each line with a word: its place, 128 bits of it, and the lengths of the
    shortest runs of ``min_words`` that begin and that end here, 0 where the document has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, "text"):
            rows, place, hashes, ahead, back = [], [], [], [], []
            for i, text in enumerate(utf8(shard["text"])):
                lines = [(x, n) for x in text.split(b"\n") if (n := len(x.split()))] if text else []
                if not lines:
                    continue
                total = np.concatenate([[0], np.cumsum([n for _, n in lines])])
                at = np.arange(len(lines))
                stop = np.searchsorted(total, total[:-1] + min_words, "left")
                begin = np.searchsorted(total, total[1:] - min_words, "right") - 1
                ahead.append(np.where(stop <= len(lines), stop - at, 0))
                back.append(np.where(begin >= 0, at + 1 - begin, 0))
                rows.append(np.full(len(lines), i))
                place.append(at)
                hashes += [xxhash.xxh3_128_digest(x) for x, _ in lines]
            if rows:
                h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                take = pa.array(np.concatenate(rows))
                values = [shard["d"].take(take), shard["t"].take(take), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (place,)),
                          pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (ahead, back))]
                yield pa.RecordBatch.from_arrays(values, ["d", "t", "p", "ha", "hb", "ahead", "back"])
    return run


def _ranked(df: DataFrame, key: list[str], rank: str) -> DataFrame:
    """(key, rank) of the keys that occur twice or more; the rank grows with the key."""
    twice = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    return cut(twice.orderBy(*key).withColumn(rank, F.monotonically_increasing_id()))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, runs): the later copies to delete in each document, as (first line, number of lines)."""
    lines = cut(docs.select("d", "t", "text").mapInArrow(_lines(min_words), "d long, t long, p int, ha long, hb long, ahead int, back int"))
    active = cut(lines.join(_ranked(lines, ["ha", "hb"], "r"), ["ha", "hb"]).select(*AT, "p", "r", "ahead", "back").distinct())
    windows = active.select(*AT, F.col("p").alias("s"), F.col("ahead").alias("size")) \
        .unionByName(active.select(*AT, (F.col("p") + 1 - F.col("back")).cast("int").alias("s"), F.col("back").alias("size"))).where("size > 0")
    longest = windows.agg(F.max("size")).first()[0] or 0
    level = active.select(*AT, "p", "r")
    levels = level.withColumn("k", F.lit(0))
    for k in range(1, longest.bit_length()):
        half = 1 << (k - 1)
        pairs = level.join(level.select(*AT, (F.col("p") - half).cast("int").alias("p"), F.col("r").alias("r2")), [*AT, "p"])
        level = cut(pairs.join(_ranked(pairs, ["r", "r2"], "name"), ["r", "r2"]).select(*AT, "p", F.col("name").alias("r")))
        levels = levels.unionByName(level.withColumn("k", F.lit(k)))
    named = windows.distinct().withColumn("k", (F.length(F.bin("size")) - 1).cast("int")).withColumn("e", F.expr("s + size - shiftleft(1, k)"))
    named = named.join(levels.select(*AT, "k", F.col("p").alias("s"), F.col("r").alias("ra")), [*AT, "k", "s"]) \
        .join(levels.select(*AT, "k", F.col("p").alias("e"), F.col("r").alias("rb")), [*AT, "k", "e"]).select(*AT, "s", "size", "ra", "rb")
    named = cut(named)
    first = named.groupBy("size", "ra", "rb").agg(F.min(F.struct(*AT, "s")).alias("first"))
    later = named.join(first, ["size", "ra", "rb"]).where(F.struct(*AT, "s") != F.col("first"))
    return later.groupBy(*AT).agg(F.collect_list(F.struct("s", "size")).alias("runs"))


def _delete(added: list[str]):
    """The rows without the lines in their runs; ``added`` are the columns to drop, the last of which holds the runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, "text"):
            texts, n, removed = [], [], []
            for text, runs in zip(utf8(shard["text"]), shard[added[-1]].to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                places = [i for i, x in enumerate(lines) if x.split()]
                gone = {places[p] for r in runs or () for p in range(r["s"], r["s"] + r["size"])}
                texts.append(text if not gone else b"\n".join(x for i, x in enumerate(lines) if i not in gone))
                n.append(len(places))
                removed.append(len(gone))
            at = shard.schema.get_field_index("text")
            yield shard.set_column(at, "text", pa.array([None if t is None else t.decode() for t in texts], pa.string())).drop_columns(added) \
                .append_column("lines_seen", pa.array(n, pa.int64())).append_column("lines_removed", pa.array(removed, pa.int64()))
    return run


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later copies cut out of ``text``, and ``lines_seen`` and ``lines_removed`` (lines with a word)."""
    docs = docs.drop("lines_seen", "lines_removed")
    place = [F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), F.xxhash64("text")]
    runs = repeated_runs(docs.select(place[0].alias("d"), place[1].alias("t"), "text"), min_words)
    added = [fresh_name(docs, c) for c in ("sort", "text", "runs")]
    keyed = docs.withColumns(dict(zip(added, place, strict=False)))
    joined = keyed.join(runs.toDF(*added), added[:2], "left").select(*docs.columns, *added)
    return joined.mapInArrow(_delete(added), columns_schema(docs, "lines_seen long, lines_removed long"))
