import itertools

import numpy as np
from pyspark.sql import functions as F

from helpers import rows
from moteflow.operators import linking as L, trackers as K
from moteflow.plans import graph as G, kernels as N


def labels(df):
    return {r.row_id: r.track_number for r in df.collect()}


def best_by_force(a, b, w):
    best = 0.0
    def rec(k, used, tot):
        nonlocal best
        best = max(best, tot)
        for e in range(k, len(a)):
            if a[e] not in used and b[e] not in used:
                rec(e + 1, used | {a[e], b[e]}, tot + w[e])
    rec(0, frozenset(), 0.0)
    return best


def test_assignment_and_matching_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(3, 8))
        ab = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6]
        if not ab:
            continue
        a, b = np.array(ab).T
        w = rng.random(len(a)) * 10
        k = N.match_edges(a, b, w)
        assert len(set(a[k]) | set(b[k])) == 2 * k.sum() and abs(w[k].sum() - best_by_force(a, b, w)) < 1e-9
        k = N.assign_edges(a, b, w)
        assert abs(w[k].sum() - best_by_force(a, b + 100, w)) < 1e-9


def test_assignment_is_global_not_greedy(spark):
    e = spark.createDataFrame([("m", 1, 10, 20, 1.0), ("m", 1, 10, 21, 2.0), ("m", 1, 11, 20, 1.1), ("m", 1, 11, 21, 100.0)], "movie string, frame int, aid long, bid long, cost double")
    for group in (["movie", "frame"], None):
        assert {(r.aid, r.bid) for r in L.assign(e, 50.0, group).collect()} == {(10, 21), (11, 20)}


def test_distributed_assignment_matches_one_kernel(spark):
    rng = np.random.default_rng(1)
    recs = [(f"m{m}", f, m * 10000 + f * 100 + i, m * 10000 + f * 100 + 50 + j, float(rng.random() * 60)) for m in range(2) for f in range(4) for i in range(6) for j in range(6) if rng.random() < 0.5]
    e = spark.createDataFrame(recs, "movie string, frame int, aid long, bid long, cost double")
    want = 0.0
    for _, g in itertools.groupby(recs, key=lambda r: r[:2]):
        g = list(g)
        a, b, w = np.array([r[2] for r in g]), np.array([r[3] for r in g]), 50 - np.array([r[4] for r in g])
        ok = w > 0
        want += w[ok][N.assign_edges(a[ok], b[ok], w[ok])].sum()
    for group in (["movie", "frame"], None):
        got = L.assign(e, 50.0, group).agg(F.sum(50 - F.col("cost"))).first()[0]
        assert abs(got - want) < 1e-9


def test_assignment_takes_hashed_ids(spark):
    """Ids beyond 2**62 and ids that both sides share."""
    big = 2 ** 63 - 5
    e = spark.createDataFrame([("m", big, big, 1.0), ("m", big, 7, 2.0), ("m", -big, big, 2.0), ("m", -big, 7, 40.0)], "movie string, aid long, bid long, cost double")
    for group in (["movie"], None):
        assert {(r["aid"], r["bid"]) for r in L.assign(e, 50.0, group).collect()} == {(big, 7), (-big, big)}


def test_components_chains_and_greedy_equal_plain_python(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2)) if a != b]
    edges = spark.createDataFrame(pairs, "a long, b long")
    label = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {tuple(r) for r in G.connected_components(edges).collect()} == set(label.items())
    nodes = spark.range(0, 30).withColumnRenamed("id", "node")
    links = spark.createDataFrame([(i, i + 1) for i in range(29) if i not in (7, 20)], "prev long, next long")
    assert {tuple(r) for r in G.chain_heads(nodes, links).collect()} == {(i, 0 if i <= 7 else 8 if i <= 20 else 21) for i in range(30)}
    better = {(min(p), max(p)) for p in pairs}
    kept = []
    for i in range(60):
        if not any((k, i) in better for k in kept):
            kept.append(i)
    assert sorted(r[0] for r in G.greedy_keep(spark.range(0, 60), spark.createDataFrame(sorted(better), "win long, lose long")).collect()) == kept


def test_slow_movers_and_gaps(spark):
    xs = [10, 12.5, 15, 22.5, 25, 100, 100.3, 100.1, 100.2]
    df = rows(spark, [{"f": f, "x": x, "y": 50} for f, x in zip([1, 2, 3, 6, 7, 1, 2, 3, 4], xs)])
    t = labels(L.track_lap(df))
    assert len({t[i] for i in range(5)}) == 1 and len({t[i] for i in range(5, 9)}) == 1 and t[0] != t[5]


def test_crossing_movers_and_fast_gap(spark):
    recs = [{"f": f, "x": x0 + v * (f - 1), "y": 50 + 3 * k, "t": k} for k, (x0, v) in enumerate([(0.0, 4.0), (40.0, -4.0)]) for f in range(1, 11) if not (k == 0 and f == 6)]
    df = rows(spark, recs)
    assert df.join(K.track_nearest(df).select("row_id"), "row_id").count() == len(recs)
    for track in (L.track_lap, K.track_kalman):
        t = labels(track(df))
        assert all(len({t[i] for i, r in enumerate(recs) if r["t"] == k}) == 1 for k in (0, 1)), track
    fast = rows(spark, [{"f": f, "x": 7.0 * (f - 1), "y": 0} for f in (1, 2, 3, 6, 7, 8)])
    assert len(set(labels(K.track_kalman(fast)).values())) == 1
    assert len(set(labels(L.track_lap(fast)).values())) > 1


def test_depth_gate_forbids_jumps(spark):
    recs = [{"f": f, "x": 50, "y": 50, "z": 0.0 if f <= 3 else 17.0, "sd": 0.3} for f in range(1, 7)]
    df = rows(spark, recs)
    assert len(set(labels(L.track_lap(df)).values())) == 1
    assert len(set(labels(L.track_lap(df, depth=True)).values())) == 2


def test_islands_give_the_result_of_the_whole_field(spark, sf):
    """Kalman over islands equals one island holding everything."""
    from moteflow.catalog import views as V
    df = V.loc(spark, sf).cache()
    def sets(d):
        g = d.groupBy("movie", "track_number").agg(F.sort_array(F.collect_list("row_id")).alias("r"))
        return {tuple(r.r) for r in g.collect()}
    whole = K._labelled(df, K._run(df.withColumn("island", F.lit(0).cast("long")), K.DEFAULTS, K.KalmanLinker, False))
    assert sets(K.track_kalman(df)) == sets(whole)
    whole = K._labelled(df, K._run(df.withColumn("island", F.lit(0).cast("long")), K.DEFAULTS, K.NearestLinker, False))
    assert sets(K.track_nearest(df)) == sets(whole)


def test_retrack_checks_input(spark):
    import pytest
    with pytest.raises(ValueError):
        K.retrack(rows(spark, [{"f": 1, "x": 1}]), "unknown")
    df = rows(spark, [{"f": 1, "x": 1, "y": 1}, {"f": 2, "x": 1, "y": 1}])
    assert all(r.short for r in K.retrack(df, "nearest").collect())


def test_matching_of_a_crowded_frame_takes_no_branching(monkeypatch):
    import itertools
    from moteflow.plans import kernels as N
    rng = np.random.default_rng(4)

    def best(edges):
        return max(sum(e[2] for e in c) for r in range(len(edges) + 1) for c in itertools.combinations(edges, r) if len({n for e in c for n in e[:2]}) == 2 * r)

    for width in (18, 2):  # by the sweep, and by branching
        monkeypatch.setattr(N, "FRONTIER", width)
        for _ in range(15):
            a, b = np.triu_indices(7, 1)
            m = rng.permutation(len(a))[:12]
            a, b, w = a[m], b[m], rng.uniform(1, 26, 12)
            x = N.match_edges(a, b, w)
            assert len(set(a[x]) | set(b[x])) == 2 * x.sum() and np.isclose(w[x].sum(), best(list(zip(a.tolist(), b.tolist(), w.tolist()))))
    monkeypatch.setattr(N, "FRONTIER", 18)
    monkeypatch.setattr(N, "_branched", None)
    k = np.arange(0, 300)  # a band of triangles: branching would not end
    a, b = np.r_[k, k], np.r_[k + 1, k + 2]
    w = rng.uniform(10, 11, len(a))
    x = N.match_edges(a, b, w)
    step = {(p, q): v for p, q, v in zip(a.tolist(), b.tolist(), w.tolist())}
    best_of = {}

    def upto(i, used):
        if i > 301:
            return 0.0
        if (i, used) not in best_of:
            free = [o for o in (i + 1, i + 2) if (i, o) in step and not used >> (o - i) & 1]
            best_of[i, used] = max([upto(i + 1, used >> 1)] + ([] if used & 1 else [step[i, o] + upto(i + 1, (used | 1 << (o - i)) >> 1) for o in free]))
        return best_of[i, used]
    assert np.isclose(w[x].sum(), upto(0, 0))


def test_clusters_around_one_node_need_no_solver(monkeypatch):
    rng = np.random.default_rng(5)
    hub, leaf = np.repeat(np.arange(40), 3), np.arange(120)
    w = rng.integers(1, 4, 120).astype(float)
    want = np.zeros(120, bool)
    want[[3 * k + int(np.argmax(w[3 * k:3 * k + 3])) for k in range(40)]] = True
    monkeypatch.setattr(N, "min_cost_rows", None)
    assert (N.assign_edges(hub, leaf, w) == want).all() and (N.assign_edges(leaf, hub, w) == want).all()


def test_undecided_edges_are_dealt_to_tasks_by_number(spark, monkeypatch):
    monkeypatch.setattr(L, "EDGES_PER_TASK", 10)
    edges = [("m", 2 * k + i, 2 * k + j, 1.0 + 0.1 * ((i + j + k) % 3)) for k in range(50) for i in (0, 1) for j in (0, 1)]
    out = L.assign(spark.createDataFrame(edges, "movie string, aid long, bid long, cost double"), 64.0, None)
    got = [(r.aid, r.bid) for r in out.collect()]
    assert len(got) == len({a for a, _ in got}) == len({b for _, b in got}) == 100
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_islands_are_streamed_without_a_table_for_each_frame(monkeypatch):
    import types

    import pandas as pd
    from moteflow.settings import DEFAULTS
    rng = np.random.default_rng(6)
    recs = [("m", isl, f, 1000 * isl + 10 * f + k, 50.0 * isl + 3 * k + rng.normal(0, 0.5), 5.0 * k + rng.normal(0, 0.5), 10.0)
            for isl in (1, 2) for f in range(1, 40) for k in range(3) if f % 11]
    pdf = pd.DataFrame(recs, columns=["movie", "island", "frame_number", "row_id", "xMean", "yMean", "angleDegrees"])
    made = []
    monkeypatch.setattr(K, "pd", types.SimpleNamespace(DataFrame=lambda d: made.append(1) or pd.DataFrame(d), arrays=pd.arrays, concat=pd.concat))
    got = []
    for size in (1, 7, len(pdf)):
        parts = [pdf.iloc[i:i + size] for i in range(0, len(pdf), size)]
        before = len(made)
        got.append(pd.concat(K.stream_islands(DEFAULTS, K.KalmanLinker, True)(iter(parts)), ignore_index=True))
        assert len(made) - before <= len(parts) + 1
        assert got[-1].equals(got[0]) and list(got[-1].columns) == K.OUT.fieldNames()
    assert sorted(got[0]["row_id"].dropna()) == sorted(pdf["row_id"]) and got[0]["px"].notna().sum() > 0
