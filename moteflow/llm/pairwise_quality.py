"""Quality scores by Bradley-Terry ranking of preference pairs.

A document's score is linear in features of its whole text. Preference pairs match a document of label 1 with one of
label 0; the weights minimise the logistic loss of the pairs' feature differences (Newton steps, whose gradient and
curvature are summed over partitions by Spark). The cut is a score quantile: the one that leaves as large a share below it as
label 0 has among all training rows that have a label and a document; it lies halfway between the two scores around it and comes from all these rows, not from the sample.
Scores are mapped to (0, 1) so that the cut is at ``CUT``.

Fitted on at most ``SAMPLE`` training rows per label, those with the smallest hash of the id, and ``PARTNERS`` pairs for
each row of the rarer label. Everything else covers all rows.

Null and empty texts are scored like any other: all their features are 0 but the one that marks them. Labels that are
null or neither 0 nor 1 are not used; several labels of one document all count. With no label of one kind all scores are
0.5. Repeated rows get the same score each; rows of equal score are on the same side of the cut, where a score equal to it is above. A column ``quality_score`` is replaced, other columns are carried along.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from moteflow.llm.common import columns_schema, lowest, shards, utf8
from moteflow.plans.quantile import exact_quantiles
from moteflow.session import cut

SAMPLE = 10_000
PARTNERS = 8
STEPS = 8
RIDGE = 1e-2
CUT = 0.3
_CLASSES = bytes(97 if 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c in (9, 11, 12, 13, 32) else 10 if c == 10 else 46 if c in b".,;:" else 200 if c >= 128 else 35 for c in range(256))
N_FEATURES = 13


def features(text: bytes | None) -> list[float]:
    """Shape of a text: length, word lengths, repetition, and shares of kinds of characters."""
    words = (text or b"").split()
    if not words:
        return [0.0] * (N_FEATURES - 1) + [1.0]
    kinds, n, w = text.translate(_CLASSES), len(text), len(words)
    sizes = np.fromiter(map(len, words), np.int64, w)
    share = [kinds.count(k) / n for k in (b"A", b"0", b"#", b"\xc8")]
    echo = sum(map(operator.eq, words, words[1:]))
    return [np.log1p(w), sizes.mean(), sizes.std(), (sizes < 4).mean(), len(set(words)) / w, echo / w, (echo + sum(map(operator.eq, words, words[2:]))) / w,
            *share, min(1.0, kinds.count(b".") / w), 0.0]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in shards(batches, "text"):
        values = pa.array([features(t) for t in utf8(shard["text"])], pa.list_(pa.float64()))
        yield shard.drop_columns(["text"]).append_column("features", values)


@dataclass
class Ranker:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def rank(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        s = self.rank(x) - self.cut + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(s, -700, 700)))


def fit_ranker(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, partners: int = PARTNERS) -> Ranker | None:
    """``labels(doc_id, quality)``: the training labels. None where one of the two labels has no document."""
    marked = labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = lowest(marked.join(docs.select("doc_id"), "doc_id", "left_semi"), "quality", sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * sample rows
    train = cut(texts.mapInArrow(_featured, "doc_id long, quality int, n int, features array<double>"))
    table = train.select("quality", "features").toPandas()  # at most 2 * sample rows and repeats of them
    if table["quality"].nunique() < 2:
        return None
    x = np.vstack(table["features"])
    centre, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    ranker = Ranker(centre, scale, _newton(_pairs(train, partners), centre, scale), 0.0)
    # the cut looks at every labelled row: scores travel to their labels, texts stay where they are
    scored = cut(docs.select("doc_id", "text").mapInArrow(_ranked(ranker), "doc_id long, rank double").join(marked, "doc_id"))
    n, below = scored.agg(F.count("*"), F.count_if(F.col("quality") == 0)).first()
    middle = exact_quantiles(scored, [], "rank", {"cut": (below - 0.5) / (n - 1)}).first()["cut"]
    return Ranker(centre, scale, ranker.weights, float(middle))


def _ranked(ranker: Ranker):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, "text"):
            x = np.array([features(t) for t in utf8(shard["text"])], float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([shard["doc_id"], pa.array(ranker.rank(x))], ["doc_id", "rank"])
    return run


def _pairs(train: DataFrame, partners: int) -> DataFrame:
    """(difference): features of a document of label 1 minus those of one of label 0, dealt out evenly."""
    dense = train.withColumn("k", F.row_number().over(Window.partitionBy("quality").orderBy("n", "doc_id")) - 1)
    good, bad = (dense.where(F.col("quality") == q).select("k", "features") for q in (1, 0))
    n_good, n_bad = good.count(), bad.count()
    few, many, n_many = (bad, good, n_good) if n_bad <= n_good else (good, bad, n_bad)
    dealt = few.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(partners - 1)))) \
        .select(F.col("features").alias("f"), ((F.col("k") * partners + F.col("r")) % n_many).alias("k"))
    sign = 1.0 if few is bad else -1.0
    both = dealt.join(many.select("k", F.col("features").alias("m")), "k")
    return cut(both.select(F.zip_with("m", "f", lambda m, f: (m - f) * sign).alias("difference")))


def _newton(pairs: DataFrame, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    k = len(centre)
    weights = np.zeros(k)
    for _ in range(STEPS):
        def sums(batches: Iterator[pa.RecordBatch], w: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + k + k * k)
            for batch in batches:
                d = np.array(batch["difference"].to_pylist(), float).reshape(-1, k) / scale
                p = 1 / (1 + np.exp(np.clip(d @ w, -700, 700)))
                total += np.concatenate([[len(d)], p @ d, ((d * (p * (1 - p))[:, None]).T @ d).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["s"])
        total = np.sum([r[0] for r in pairs.mapInArrow(sums, "s array<double>").collect()], axis=0)  # one row per task
        n, g, h = max(total[0], 1), total[1 : 1 + k], total[1 + k :].reshape(k, k)
        step = np.linalg.solve(h / n + RIDGE * np.eye(k), g / n - RIDGE * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def score_quality(docs: DataFrame, ranker: Ranker | None) -> DataFrame:
    """``docs`` with ``quality_score``; the other columns are carried along."""
    docs = docs.drop("quality_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, "text"):
            x = np.array([features(t) for t in utf8(shard["text"])], float).reshape(-1, N_FEATURES)
            yield shard.append_column("quality_score", pa.array(np.full(len(x), 0.5) if ranker is None else ranker.score(x)))

    return docs.mapInArrow(run, columns_schema(docs, "quality_score double"))
