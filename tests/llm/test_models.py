"""Context trees and the quality ranking against independent plain versions."""

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from moteflow.llm import line_runs, pairwise_quality, poisson_mix, ppm_language, secret_ledger
from test_llm import DOCS, no_rows, vocabulary


def plain_bits(train, text):
    """Code length of ``text`` by dictionaries of contexts: a mark of None stands before each text."""
    follow = defaultdict(Counter)
    for t in train:
        s = [None] * 3 + list(t)
        for i in range(3, len(s)):
            for k in range(4):
                follow[tuple(s[i - k : i])][s[i]] += 1
    total, s = 0.0, [None] * 3 + list(text)
    for i in range(3, len(s)):
        for k in (3, 2, 1, 0):
            c = follow[tuple(s[i - k : i])] if tuple(s[i - k : i]) in follow else {}
            n, d = sum(c.values()), len(c)
            if s[i] in c:
                total -= math.log2(c[s[i]] / (n + d))
                break
            total -= math.log2(d / (n + d)) if n else 0
        else:
            total += 8
    return total


def test_code_lengths_equal_plain_context_trees(spark):
    r = random.Random(4)
    v = {"xx": vocabulary(11, 40), "yy": vocabulary(12, 40), "zz": ["ж", "щи", "да", "\x00\xff", "日本", "語"]}
    rows = [(i, " ".join(r.choice(v[k]) for _ in range(r.randint(0, 30))), k, "s", 0) for i, k in enumerate(["xx", "yy", "zz"] * 25)]
    docs = spark.createDataFrame(rows, DOCS)
    (trees,) = ppm_language.fit_trees(docs)
    texts = [t.encode() for _, t, *_ in rows[:9]] + [b"", b"a", bytes(range(256)), "щи日".encode() * 3, b"\xff\xfe zz"]
    got = ppm_language.code_lengths(texts, trees.value)
    assert trees.value.langs == ["xx", "yy", "zz"]
    for j, lang in enumerate(trees.value.langs):
        train = [t.encode() for _, t, k, *_ in rows if k == lang]
        for i, t in enumerate(texts):
            assert abs(got[i, j] - plain_bits(train, t)) < 1e-3 * max(1, len(t))
    # no byte is merged: scripts that differ in rare bytes only are told apart
    out = ppm_language.identify(spark.createDataFrame([(1, "щи да ж", None, None, 0), (2, "日本 語", None, None, 0)], DOCS), [trees]).collect()
    assert {x["lang_pred"] for x in out} == {"zz"}


def test_languages_that_cannot_be_told_apart_go_to_the_first(spark):
    same = [(i, "one two three", k, "s", 0) for i, k in enumerate(["b", "a", "c"])]
    docs = spark.createDataFrame(same, DOCS).withColumn("_letters", F.lit(7))
    out = ppm_language.identify(docs, ppm_language.fit_trees(docs)).collect()
    assert {(x["lang_pred"], x["_letters"]) for x in out} == {("a", 7)} and all(abs(x["lang_score"] - 1 / 3) < 1e-6 for x in out)
    assert ppm_language.identify(no_rows(spark), ppm_language.fit_trees(docs)).count() == 0


def labelled(spark):
    r = random.Random(9)
    v = vocabulary(9)
    text = lambda q: " ".join(r.choice(v) if r.random() < (0.9 if q else 0.5) else r.choice(["###", "42", "AA", "a"]) for _ in range(r.randint(20, 60)))
    rows = [(i, text(i % 3 != 0), "en", "s", 0) for i in range(240)]
    labels = [(i, int(i % 3 != 0) if r.random() < 0.9 else int(i % 3 == 0)) for i in range(0, 300) if i % 2]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels), rows


def test_weights_minimise_the_pair_loss_and_the_cut_is_the_quantile(spark):
    docs, labels, marks, rows = labelled(spark)
    ranker = pairwise_quality.fit_ranker(docs, labels)
    x = np.array([pairwise_quality.features(t.encode()) for _, t, *_ in rows])
    known = [i for i in range(len(rows)) if i in marks]
    z = (x - ranker.centre) / ranker.scale
    assert np.allclose(ranker.centre, x[known].mean(0)) and np.allclose(ranker.scale, np.where(x[known].std(0) > 1e-9, x[known].std(0), 1))
    train = spark.createDataFrame([(i, marks[i], 0, x[i].tolist()) for i in known], "doc_id long, quality int, n int, features array<double>")
    d = np.array([p[0] for p in pairwise_quality._pairs(train, 8).collect()]) / ranker.scale
    w = np.zeros(d.shape[1])
    for _ in range(4000):  # plain gradient descent on the same kind of loss
        w += 0.3 * ((d / (1 + np.exp(d @ w))[:, None]).mean(0) - pairwise_quality.RIDGE * w)
    pairs = spark.createDataFrame([((p * ranker.scale).tolist(),) for p in d], "difference array<double>")
    assert np.allclose(pairwise_quality._newton(pairs, ranker.centre, ranker.scale), w, atol=1e-3)
    s = np.sort((z @ ranker.weights)[known])
    below = sum(marks[i] == 0 for i in known)
    assert abs(ranker.cut - (s[below - 1] + s[below]) / 2) < 1e-9
    got = {q["doc_id"]: q["quality_score"] for q in pairwise_quality.score_quality(docs, ranker).collect()}
    assert sum(got[i] < pairwise_quality.CUT for i in known) == below


def test_the_cut_covers_rows_beyond_the_sample_and_labels_without_documents(spark):
    docs, labels, marks, rows = labelled(spark)
    ranker = pairwise_quality.fit_ranker(docs, labels, sample=20)
    known = [i for i in range(len(rows)) if i in marks]
    s = np.sort(ranker.rank(np.array([pairwise_quality.features(rows[i][1].encode()) for i in known])))
    below = sum(marks[i] == 0 for i in known)
    assert abs(ranker.cut - (s[below - 1] + s[below]) / 2) < 1e-9
    many = labels.unionByName(spark.range(1000, 4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")))
    other = pairwise_quality.fit_ranker(docs, many, sample=20)
    assert np.allclose(other.weights, ranker.weights) and abs(other.cut - ranker.cut) < 1e-9


def test_offsets_are_code_points_in_linear_time():
    text = ("é日 token = abcdefghijkl1234 \U0001f600 " * 20_000).encode()
    t = time.perf_counter()
    spans = secret_ledger.code_points(text, secret_ledger.scan_text(text))
    assert len(spans) == 20_000 and time.perf_counter() - t < 5
    whole = text.decode()
    assert all(whole[a:b] == "token = abcdefghijkl1234" for _, a, b in spans)


def test_a_second_version_scans_unseen_blobs_only(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    rows = [(1, "password = abcdefghijkl1", "en", "s", 0), (2, "nothing", "en", "s", 0), (3, None, "en", "s", 0), (4, "password = abcdefghijkl1", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    first = {r["doc_id"]: r["scanned"] for r in secret_ledger.scan_secrets(docs.where("doc_id < 3"), ledger).collect()}
    assert first == {1: True, 2: True}
    second = secret_ledger.scan_secrets(docs, ledger).collect()
    assert {r["doc_id"]: r["scanned"] for r in second} == {1: False, 2: False, 3: True, 4: False} and sum(len(r["findings"]) for r in second) == 2
    assert {r["scanned"] for r in secret_ledger.scan_secrets(docs, ledger, rules="next").collect()} == {True}


def test_large_rates_are_sums_of_parts_and_unreachable_weights_are_refused(spark):
    docs = spark.createDataFrame([(i, "t", "en", "few", 0) for i in range(300)], DOCS)
    n = np.array([r[0] for r in docs.select(poisson_mix.copies({"few": 700.0, None: 1.0})).collect()])
    assert abs(n.mean() - 700) < 6 and 0.7 < n.var() / 700 < 1.4
    again = np.array([r[0] for r in docs.select(poisson_mix.copies({"few": 700.0, None: 1.0})).collect()])
    assert (n == again).all() and len(poisson_mix.cumulated(poisson_mix.PIECE)) < 400
    with pytest.raises(ValueError):
        poisson_mix.copies({"few": 2e6, None: 1.0})


def test_line_dedup_carries_columns_of_any_name(spark):
    line = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"{line}\na", 5, 6, 7), (2, f"b\n{line}", 8, 9, 10)], "doc_id long, text string, _sort int, _TEXT int, runs int").withColumnRenamed("runs", "_runs")
    got = {r["doc_id"]: r for r in line_runs.dedup_lines(docs).collect()}
    assert got[1]["text"] == f"{line}\na" and got[2]["text"] == "b" and (got[2]["_sort"], got[2]["_TEXT"], got[2]["_runs"]) == (8, 9, 10)
