"""Language-model scores by a hidden Markov model over words.

Words are runs without ASCII white space, A-Z in small letters; a text's words are followed by one end token. Word counts
cover all training texts and grow with them. The ``COMMON`` most frequent words are symbols of their own, every other word belongs to
one of ``CLASSES`` classes by its last two bytes, and the end is a symbol. A text's probability is that of its symbols
under the hidden chain (forward recursion, scaled at each token) times that of each rarer word within its class,
(count + 0.5) / (class count + 0.5 * (class words + 1)).

Training is Baum-Welch: ``PASSES`` passes go over all training texts, from a start that only knows the corpus frequencies
of the symbols. Each task adds up the expected starts, moves and emissions of its texts in segments of at most
``SEGMENT`` tokens, Spark sums them by symbol, and the driver holds the sums, whose size is fixed. Emissions are
smoothed towards the corpus frequencies of the symbols.

Texts are encoded once, to a written table. Rarer words are joined with their counts, so no word list grows in a task or at the driver.

A null text counts as empty: one token, the end. Repeated rows get the same result each. With no training text, counts are 0,
every symbol is equally likely, and nothing is known.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from moteflow.llm.common import LOWER, Flat, shards, utf8
from moteflow.session import cut

COMMON, CLASSES, STATES = 6_000, 256, 8
PASSES, SEGMENT = 6, 256
PRIOR = 20.0
TOGETHER, ROWS, PIECE = 200_000, 1_024, 2_000_000
END = b""


@dataclass
class Chain:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol, state


class Symbols(dict):
    """Word to symbol; rarer words by class, remembered for a while."""

    LIMIT = 50_000

    def __init__(self, common: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(common))
        self.common = len(common)

    def __missing__(self, word: bytes) -> int:
        s = COMMON + zlib.crc32(word[-2:]) % CLASSES
        if len(self) < self.LIMIT:
            self[word] = s
        return s


N_SYMBOLS = COMMON + CLASSES + 1


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in shards(batches, "text", PIECE):
        n = Counter(w for t in utf8(shard["text"]) for w in (t or b"").translate(LOWER).split())
        n[END] = shard.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])


def _encoder(common: list[bytes], logs: np.ndarray, end_log: float, ends_known: int):
    """Rows (uid, doc_id, held, tokens, known, base, symbols, rare); base and known are those of the common words and the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, uid = Symbols(common), TaskContext.get().partitionId() << 40
        for shard in shards(batches, "text", PIECE):
            words = [(t or b"").translate(LOWER).split() for t in utf8(shard["text"])]
            flat = Flat(np.array([len(w) for w in words]))
            s = np.fromiter(map(symbols.__getitem__, (x for w in words for x in w)), np.int16, flat.total)
            common_word = s < COMMON
            table = np.concatenate([logs, np.zeros(N_SYMBOLS - len(logs))])
            base, known = flat.sums(table[s]) + end_log, flat.sums(common_word) + ends_known
            rare = [list(Counter(w[i] for i in np.flatnonzero(~common_word[a : a + n])).items()) for w, a, n in zip(words, flat.starts, flat.sizes, strict=True)]
            listed = Flat(np.array([len(r) for r in rare]))
            pairs = pa.StructArray.from_arrays([pa.array([x for r in rare for x, _ in r], pa.binary()), pa.array([x for r in rare for _, x in r], pa.int32())], ["word", "n"])
            end = np.array([N_SYMBOLS - 1], np.int16).tobytes()
            coded = [s[a : a + n].tobytes() + end for a, n in zip(flat.starts, flat.sizes, strict=True)]
            ids = pa.array(np.arange(uid, uid + len(words)))
            uid += len(words)
            offsets = pa.array(np.concatenate([listed.starts, [listed.total]]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids, shard["doc_id"], shard["held"], pa.array(flat.sizes + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(coded, pa.binary()),
                                              pa.ListArray.from_arrays(offsets, pairs)], ["uid", "doc_id", "held", "tokens", "known", "base", "symbols", "rare"])
    return run


def _active(sizes: np.ndarray) -> np.ndarray:
    """For sizes in falling order: how many are larger than t, for each t."""
    return len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(sizes) else 0), "right")


def log_likelihoods(symbols: np.ndarray, flat: Flat, chain: Chain) -> np.ndarray:
    """Natural logarithm of each sequence's probability: the forward recursion over all sequences side by side."""
    order = np.argsort(-flat.sizes, kind="stable")
    starts, active = flat.starts[order], _active(flat.sizes[order])
    out = np.zeros(len(order))
    state = np.tile(chain.start, (len(order), 1))
    for t, m in enumerate(active):
        state = (state[:m] if t == 0 else state[:m] @ chain.move) * chain.emit[symbols[starts[:m] + t]]
        scale = state.sum(axis=1)
        out[order[:m]] += np.log(scale)
        state /= scale[:, None]
    return out


def expectations(symbols: np.ndarray, flat: Flat, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions (symbol, state) of the sequences."""
    order = np.argsort(-flat.sizes, kind="stable")
    starts, active = flat.starts[order], _active(flat.sizes[order])
    move, emit = chain.move.astype(np.float32), chain.emit.astype(np.float32)
    n, k = len(order), len(chain.start)
    alpha, scale = np.zeros((len(active), n, k), np.float32), np.ones((len(active), n), np.float32)
    for t, m in enumerate(active):
        a = (chain.start.astype(np.float32) if t == 0 else alpha[t - 1, :m] @ move) * emit[symbols[starts[:m] + t]]
        scale[t, :m] = a.sum(axis=1)
        alpha[t, :m] = a / scale[t, :m, None]
    beta, moves = np.ones((n, k), np.float32), np.zeros((k, k))
    seen = []
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        obs = symbols[starts[:m] + t]
        seen.append(obs)
        after = emit[obs] * beta[:m] / scale[t, :m, None]
        alpha[t, :m] *= beta[:m]
        if t:
            moves += alpha[t - 1, :m].T @ after
            beta[:m] = after @ move.T
    gamma = np.concatenate([alpha[t, : active[t]] for t in range(len(active) - 1, -1, -1)]) if len(active) else np.zeros((0, k))
    obs = np.concatenate(seen) if seen else np.zeros(0, np.int64)
    emissions = np.stack([np.bincount(obs, weights=gamma[:, s], minlength=N_SYMBOLS) for s in range(k)], axis=1)
    return alpha[0].sum(axis=0).astype(float) if len(active) else np.zeros(k), moves * chain.move, emissions


def _segments(column: pa.Array) -> Iterator[tuple[np.ndarray, Flat]]:
    """Symbols of many texts, cut into segments; a piece has at most TOGETHER
    tokens and ROWS segments, which bounds the arrays of a step."""
    parts, sizes, total = [], [], 0
    for text in column.to_pylist():
        s = np.frombuffer(text, np.int16)
        for i in range(0, len(s), SEGMENT):
            parts.append(s[i : i + SEGMENT])
            sizes.append(len(parts[-1]))
            total += sizes[-1]
            if total >= TOGETHER or len(sizes) >= ROWS:
                yield np.concatenate(parts), Flat(np.array(sizes))
                parts, sizes, total = [], [], 0
    if parts:
        yield np.concatenate(parts), Flat(np.array(sizes))


def _improved(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, frequency: np.ndarray) -> Chain:
    emit = emissions + PRIOR * frequency[:, None]
    return Chain((starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _first_chain(frequency: np.ndarray) -> Chain:
    random = np.random.default_rng(11)
    emit = frequency[:, None] * random.gamma(1.0, 1.0, (N_SYMBOLS, STATES)) + 1e-12
    move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
    return Chain(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))


def _sums(chain: Chain):
    """(symbol, e): expected emissions; symbol -1 holds the starts and -2 - i the moves from state i."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((N_SYMBOLS, STATES))]
        for batch in batches:
            for s, f in _segments(batch["symbols"]):
                total = [a + b for a, b in zip(total, expectations(s, f, chain), strict=True)]
        rows = np.concatenate([total[2], total[0][None], total[1]])
        names = np.concatenate([np.arange(N_SYMBOLS), [-1], -2 - np.arange(STATES)])
        keep = rows.sum(axis=1) > 0
        yield pa.RecordBatch.from_arrays([pa.array(names[keep].astype(np.int32)), *(pa.array(rows[keep, s]) for s in range(STATES))], ["symbol", *(f"e{s}" for s in range(STATES))])
    return run


def train(coded: DataFrame, frequency: np.ndarray) -> Chain:
    """Baum-Welch over all training texts in ``coded(symbols)``."""
    chain = _first_chain(frequency)
    for _ in range(PASSES):
        schema = "symbol int, " + ", ".join(f"e{s} double" for s in range(STATES))
        rows = coded.mapInArrow(_sums(chain), schema).groupBy("symbol").agg(*[F.sum(f"e{s}").alias(f"e{s}") for s in range(STATES)]).toArrow()
        full = np.zeros((N_SYMBOLS + 1 + STATES, STATES))
        at = rows["symbol"].to_numpy()
        full[np.where(at >= 0, at, N_SYMBOLS - 1 - at)] = np.stack([rows[f"e{s}"].to_numpy() for s in range(STATES)], axis=1)
        chain = _improved(full[N_SYMBOLS], full[N_SYMBOLS + 1 :], full[:N_SYMBOLS], frequency)
    return chain


def _forward(chain: Chain):
    """Appends ``chain_log10``. Longer texts wait for each other, as all texts of a group step side by side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[pa.RecordBatch]] = {}
        size: Counter[int] = Counter()

        def scored(group: int) -> pa.RecordBatch:
            b = pa.Table.from_batches(waiting.pop(group)).combine_chunks().to_batches()[0]
            size[group] = 0
            texts = [np.frombuffer(x, np.int16) for x in b["symbols"].to_pylist()]
            ll = log_likelihoods(np.concatenate(texts), Flat(np.array([len(x) for x in texts])), chain)
            return b.drop_columns(["symbols"]).append_column("chain_log10", pa.array(ll / math.log(10)))

        for batch in batches:
            n = batch["tokens"].to_numpy()
            group = np.ceil(np.log2(n + 1)).astype(int) // 2
            for g in np.unique(group):
                waiting.setdefault(g, []).append(batch.filter(pa.array(group == g)))
                size[g] += int(n[group == g].sum())
                if size[g] >= 2 * TOGETHER:
                    yield scored(g)
        for g in list(waiting):
            yield scored(g)
    return run


def score_texts(docs: DataFrame, held: Column) -> DataFrame:
    """(doc_id, held, tokens, known, train_tokens, base_score, score) for every row of ``docs(doc_id, text)``; rows
    with ``held`` are scored but not learned from."""
    docs = docs.select("doc_id", "text", held.alias("held"))
    counts = cut(docs.where("NOT held").select("text").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    log_base = math.log10(total + 0.5 * (distinct + 1))
    top = counts.where(F.octet_length("word") > 0).orderBy(F.desc("n"), "word").limit(COMMON).collect()
    common = [bytes(r[0]) for r in top]
    ends = counts.where(F.octet_length("word") == 0).first()
    n_ends = ends[1] if ends else 0
    logs = np.log10(np.array([r[1] for r in top], float) + 0.5) - log_base
    names = docs.sparkSession.createDataFrame([(w,) for w in common], "word binary")
    rare_counts = counts.where(F.octet_length("word") > 0).join(F.broadcast(names), "word", "left_anti") \
        .withColumn("class", (F.crc32(F.substring("word", -2, 2)) % CLASSES).cast("int"))  # COMMON rows are broadcast
    classes = {r[0]: (r[1], r[2]) for r in rare_counts.groupBy("class").agg(F.sum("n"), F.count("*")).collect()}
    frequency = np.full(N_SYMBOLS, 0.5)
    frequency[: len(top)] += [r[1] for r in top]
    for c, (n, _) in classes.items():
        frequency[COMMON + c] += n
    frequency[-1] += n_ends
    frequency /= frequency.sum()

    fields = "uid long, doc_id {}, held boolean, tokens long, known long, base double, symbols binary, rare array<struct<word:binary,n:int>>"
    encoder = _encoder(common, logs, math.log10(n_ends + 0.5) - log_base, int(n_ends > 0))
    coded = cut(docs.mapInArrow(encoder, fields.format(docs.schema["doc_id"].dataType.simpleString())))
    chain = train(coded.where("NOT held").select("symbols"), frequency)

    within = docs.sparkSession.createDataFrame([(c, math.log10(n + 0.5 * (v + 1))) for c in range(CLASSES) for n, v in [classes.get(c, (0, 0))]], "class int, within double")
    rare = coded.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", F.col("r.n").alias("times")) \
        .join(rare_counts.select("word", "n"), "word", "left").withColumn("class", (F.crc32(F.substring("word", -2, 2)) % CLASSES).cast("int")) \
        .join(F.broadcast(within), "class")
    log_count = F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))
    sums = rare.groupBy("uid").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * (log_count - log_base)).alias("rare_base"),
                                   F.sum(F.col("times") * (log_count - F.col("within"))).alias("rare_within"))
    plain = coded.select("uid", "doc_id", "held", "tokens", "known", "base", "symbols")
    scored = plain.mapInArrow(_forward(chain), fields.format(docs.schema["doc_id"].dataType.simpleString()).split(", symbols")[0] + ", chain_log10 double")
    zero = F.lit(0)
    return scored.join(sums, "uid", "left").select(
        "doc_id", "held", "tokens", (F.col("known") + F.coalesce("rare_known", zero)).alias("known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"), (F.col("chain_log10") + F.coalesce("rare_within", zero)).alias("score"))
