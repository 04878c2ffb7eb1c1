"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to three bytes deep counts which byte follows. A byte that was seen after
the deepest context costs -log2(count / (n + d)), where n is the context's count and d its number of different followers;
otherwise it costs the escape, -log2(d / (n + d)), and is coded in the context that is one byte shorter, down to a uniform
code. A context without counts costs nothing to leave. The counts are frozen: scoring changes nothing, and the code length
of a text is the sum over its bytes. The language with the shortest code is the prediction; the score is its
posterior under equal priors.

All 256 bytes are symbols, and a mark that is never coded stands before the start of a text. The contexts of each depth are sorted arrays of
packed symbols: a byte costs a binary search, and the few that were not seen after their deepest context go on one depth lower with the escape added. Up to
``BLOCK`` languages share the arrays; more languages go in further blocks. Their size is bounded by the training sample.

The trees are fitted on at most ``SAMPLE`` training texts per language, those with the smallest hash of the id; all texts
are scored as a whole.

A null text or one without a letter is ``und`` with score 0, as is every text when nothing can be learned. Ties go to the
language that sorts first. Repeated rows get the same result each. Columns that are called like a result are replaced by it; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from moteflow.llm.common import columns_schema, fresh_name, lowest, shards, utf8
from moteflow.session import cut

SAMPLE = 3_000
ORDER = 3
BLOCK = 8
PIECE = 3_000_000
UNDETERMINED = "und"
#: Bits of a packed symbol; bytes are 1 to 256 and 0 is the mark before a text.
WIDE = 9


class ByteTree:
    """Code lengths in bits of a block of languages. Level k has the sorted symbol runs of k + 1 that were seen in any of them with their cost in each, and
    the contexts of k symbols with the cost of leaving them."""

    def __init__(self, langs: list[str], runs: np.ndarray, counts: np.ndarray):
        """``runs``: sorted packed runs of ORDER + 1 symbols; ``counts[run, lang]``."""
        self.langs, self.levels = langs, []
        levels = [(runs, counts)]
        for k in range(ORDER, 0, -1):
            shorter, at = np.unique(levels[0][0] & ((1 << WIDE * k) - 1), return_inverse=True)
            total = np.zeros((len(shorter), counts.shape[1]))
            np.add.at(total, at, levels[0][1])
            levels.insert(0, (shorter, total))
        for k, (runs, count) in enumerate(levels):
            contexts, first, at = np.unique(runs >> WIDE, return_index=True, return_inverse=True)
            n = np.add.reduceat(count, first, axis=0) if len(first) else count
            d = np.add.reduceat((count > 0).astype(float), first, axis=0) if len(first) else count
            leave = -np.log2(np.where(n > 0, d / np.maximum(n + d, 1), 1.0))
            seen = -np.log2(np.where(count > 0, count, 1.0) / np.maximum(n + d, 1)[at])
            below = self.bits(runs & ((1 << WIDE * k) - 1), k - 1).astype(float)
            self.levels.append((runs, np.where(count > 0, seen, leave[at] + below).astype(np.float32), contexts, leave.astype(np.float32)))

    def bits(self, runs: np.ndarray, level: int = ORDER) -> np.ndarray:
        """Cost in each language of the last symbol of each run after the others."""
        if level < 0:
            return np.full((len(runs), len(self.langs)), 8.0, np.float32)
        known, cost, contexts, leave = self.levels[level]
        if not len(known):
            return self.bits(runs & ((1 << WIDE * level) - 1), level - 1)
        at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
        out = cost[at]
        missed = np.flatnonzero(known[at] != runs)
        if len(missed):
            rest = runs[missed]
            where = np.minimum(np.searchsorted(contexts, rest >> WIDE), len(contexts) - 1)
            escape = np.where((contexts[where] == rest >> WIDE)[:, None], leave[where], 0)
            out[missed] = escape + self.bits(rest & ((1 << WIDE * level) - 1), level - 1)
        return out


def _runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(packed run of ORDER + 1 symbols that ends at every byte of the texts, first position of each text)."""
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    symbols = np.zeros(starts[-1] + ORDER * len(texts), np.int64)
    place = np.arange(starts[-1]) + ORDER * np.repeat(np.arange(1, len(texts) + 1), np.diff(starts))
    symbols[place] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    out = symbols[place - ORDER]
    for k in range(ORDER - 1, -1, -1):
        out = (out << WIDE) | symbols[place - k]
    return out, starts


def fit_trees(docs: DataFrame, sample: int = SAMPLE) -> list[Broadcast]:
    """Trees of the languages in ``docs(doc_id, text, lang)``, in blocks. Rows with a null in any of the three are not used."""
    spark = docs.sparkSession
    able = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND length(text) > 0")
    ids = lowest(able.select("doc_id", "lang"), "lang", sample).select("doc_id", "lang")
    train = cut(able.select("doc_id", "lang", "text").join(ids.distinct(), ["doc_id", "lang"], "left_semi").select("lang", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, "text", PIECE):
            langs = np.array(shard["lang"].to_pylist(), object)
            texts = utf8(shard["text"])
            for lang in sorted(set(langs)):
                run, n = np.unique(_runs([texts[i] for i in np.flatnonzero(langs == lang)])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(run), pa.string()), pa.array(run), pa.array(n.astype(np.int64))], ["lang", "run", "n"])

    sums = cut(train.mapInArrow(count, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")))
    langs = sorted(r[0] for r in sums.select("lang").distinct().collect())
    out = []
    for i in range(0, len(langs), BLOCK):  # at most as many rows at the driver as the sample has bytes
        block = langs[i : i + BLOCK]
        rows = sums.where(F.col("lang").isin(block)).toArrow()
        runs, at = np.unique(rows["run"].to_numpy(), return_inverse=True)
        counts = np.zeros((len(runs), len(block)))
        counts[at, [block.index(x) for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
        out.append(spark.sparkContext.broadcast(ByteTree(block, runs, counts)))
    return out


def code_lengths(texts: list[bytes], tree: ByteTree) -> np.ndarray:
    """Bits of each text in each language of the block."""
    runs, starts = _runs(texts)
    bits = np.zeros((len(texts), len(tree.langs)))
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        bits[full] = np.add.reduceat(tree.bits(runs), starts[full], axis=0, dtype=np.float64)
    return bits


def identify(docs: DataFrame, trees: list[Broadcast]) -> DataFrame:
    """``docs`` without its text, with ``lang_pred``, ``lang_score`` and ``lang_bits``, the predicted language's code length."""
    letters = fresh_name(docs, "letters")
    docs = docs.drop("lang_pred", "lang_score", "lang_bits").withColumn(letters, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, "text", PIECE):
            texts = [t or b"" for t in utf8(shard["text"])]
            names = np.array([x for t in trees for x in t.value.langs] or [UNDETERMINED], object)
            bits = np.concatenate([code_lengths(texts, t.value) for t in trees], axis=1) if trees else np.zeros((len(texts), 1))
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(bits)), best]
            score = 1 / np.exp2(np.minimum(0, least[:, None] - bits)).sum(axis=1)
            clear = shard[letters].to_numpy(zero_copy_only=False) & bool(trees)
            yield shard.drop_columns(["text", letters]).append_column("lang_pred", pa.array(np.where(clear, names[best], UNDETERMINED), pa.string())) \
                .append_column("lang_score", pa.array(np.where(clear, score, 0.0))).append_column("lang_bits", pa.array(least))

    return docs.mapInArrow(run, columns_schema(docs.drop("text", letters), "lang_pred string, lang_score double, lang_bits double"))
