import json

import pytest
from pyspark.sql import functions as F

from helpers import rows
from moteflow.sources import tables as S

HEAD = "x1,x2,xMean,y1,y2,yMean,angleDegrees,zMicrons,frame_number,track_number"


def test_lenient_csv(spark, tmp_path):
    p = tmp_path / "a_localizations.csv"
    p.write_text("﻿" + HEAD + ",flag\n1,3,2,1,3,2,45,,1,1,true\n\n1,3,2,1,3,2,46,nan,2,1,no\n1,3,2,1,3,2,x,1.5,1,2,odd\n", encoding="utf-8")
    r = S.read_localizations(spark, str(p)).orderBy("track_number", "frame_number").collect()
    assert len(r) == 3 and r[0].zMicrons is None and r[1].zMicrons is None and r[2].angleDegrees is None
    assert [x.flag for x in r] == [1.0, 0.0, None] and r[0].frame_number == 1
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        S.read_localizations(spark, str(tmp_path / "b.csv"))


def test_drift_reading(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("frame_number,dx,dy,dz,dzRaw\n2,0.5,,1,2\n1,nan,0.1,0,1\n")
    r = {x.frame_number: x for x in S.read_drift(spark, str(p), "m").collect()}
    assert (r[1].dx, r[1].dy, r[2].dy, r[2].dz_raw) == (0.0, 0.1, 0.0, 2.0)
    p.write_text("frame_number,dx,dy,dz\n" + "\n".join(f"{i},0,0,{i}" for i in range(1, 31)))
    d = S.read_drift(spark, str(p), "m").orderBy("frame_number").toPandas()
    assert abs(d["dz"].median()) < 1e-9 and (d["dz_raw"] == d["frame_number"]).all()


def test_outputs_round_trip(spark, tmp_path):
    df = rows(spark, [{"f": f, "t": t, "x": 10 * t, "y": 5, "z": 1.0} for t in (1, 2) for f in (1, 2, 3)]).withColumnRenamed("z", "zMicrons")
    drift = spark.createDataFrame([("m", 1, 0.5, 0.0, 0.1)], "movie string, frame_number int, dx double, dy double, dz double")
    out = S.output_columns(df, drift, [[0.0] * 6, [0.0] * 6], axial_scale=2.0)
    S.write_localizations(out, str(tmp_path / "loc"))
    back = spark.read.parquet(str(tmp_path / "loc"))
    r = back.where("track_number = 1 AND frame_number = 1").first()
    assert (r.trackLength, r.xStabilized, round(r.zStabilized, 9), r.zMicrons) == (3, 9.5, 1.8, 2.0) and back.count() == 6
    S.write_rejected(df.withColumn("reject_reason", F.lit(3)), str(tmp_path / "rej"))
    assert "satellite" in spark.read.parquet(str(tmp_path / "rej")).first().reason
    S.write_csv(df.select("row_id", "xMean", "zMicrons"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 6


def test_export_and_json(spark):
    df = rows(spark, [{"f": f, "t": 3 - t, "x": t, "y": 5} for t in (1, 2) for f in (2, 1)])
    sub = spark.createDataFrame([(0,), (0,), (3,)], "row_id long")
    assert [r.row_id for r in S.export_subset(df, sub).collect()] == [3, 0]
    with pytest.raises(ValueError):
        S.export_subset(df, spark.createDataFrame([(77,)], "row_id long"))
    rec = S.column_json(df, ["track_number", "xMean", "z"]).where("frame_number = 1").first()
    assert json.loads(rec.data) == {"track_number": [2, 1], "xMean": [1.0, 2.0], "z": [None, None]}


def test_names(spark):
    df = spark.createDataFrame([("/d/cells_0.5ms_1.ome.tif",), ("scan 20X 25ums_0.04s.tif",)], "p string")
    r = df.select(S.clean_name(F.col("p")).alias("c"), S.magnification(F.col("p")).alias("o"), S.z_step_um(F.col("p"), F.lit(None).cast("double")).alias("z")).collect()
    assert [x.c for x in r] == ["cells_0_5ms_1", "scan_20X_25ums_0_04s"] and [x.o for x in r] == [None, 20] and r[0].z is None


def test_catalogue_choice(spark):
    f = spark.createDataFrame([("r", "a", "a_payload.csv", "p1"), ("r", "a", "a_localizations.csv", "p2"), ("r", "b", "b_payload.csv", "p3")], "run string, movie string, name string, path string")
    assert {r.path for r in S.preferred_file(f).collect()} == {"p2", "p3"}
    t = spark.createDataFrame([("r", "a", "localizations", 5), ("r", "a", "track_motion", 4), ("r", "a", "motion_states", 6), ("r", "b", "localizations", 1)], "run string, movie string, kind string, mtime long")
    assert {r.movie: r.motion_state for r in S.motion_state(t).collect()} == {"a": "stale", "b": "none"}


def test_json_numbers_have_no_exponent(spark):
    df = rows(spark, [{"f": 1, "t": i, "x": x} for i, x in enumerate((0.0004, -0.0002, 12345678.5, 0.25, 0.0, 1e40))])
    data = S.column_json(df, ["track_number", "xMean"]).first().data
    assert data == '{"track_number":[0,1,2,3,4,5],"xMean":[0.0004,-0.0002,12345678.5,0.25,0.0,1.0E40]}'


def test_sidecars_match_names_once(spark):
    movies = [(k, f"cell_{k % 3}1") for k in range(30)] + [(90, None), (91, "c")]
    files = [(k, f"cell_{k % 2}") for k in range(40)] + [(95, "cell_11_info"), (96, "other"), (97, None)]
    got = S.match_sidecars(spark.createDataFrame(movies, "m long, base string"), spark.createDataFrame(files, "s long, base string"), "m", "s").collect()
    of = {k: {r.a: r.b for r in got if r.kind == k} for k in ("movie", "sidecar")}
    match = [(r.a, r.b) for r in got if r.kind == "match"]
    assert of["movie"] == {k: k % 3 for k in range(30)} | {91: 91} and of["sidecar"] == {k: k % 2 for k in range(40)} | {95: 95, 96: 96}
    want = {(m, s) for m, a in movies for s, b in files if a and b and (a.startswith(b) or b.startswith(a))}
    assert {(m, s) for m in of["movie"] for s in of["sidecar"] if (of["movie"][m], of["sidecar"][s]) in set(match)} == want and len(match) == len(set(match)) == 6


@pytest.mark.parametrize("share", [3, 1000])
def test_every_movie_meets_every_matching_sidecar(spark, share):
    """All pairs, also of names that many share, once each where an id has several names or an id is missing."""
    movies = [(k, f"cell_{k % 3}1") for k in range(30)] + [(90, None), (91, "c"), (3, "cell_0"), (3, "cell_01"), (None, "cell_11"), (None, "cell_1")]
    files = [(k, f"cell_{k % 2}") for k in range(40)] + [(95, "cell_11_info"), (96, "other"), (97, None), (5, "cell_11")]
    got = S.sidecar_pairs(spark.createDataFrame(movies, "m long, base string"), spark.createDataFrame(files, "s long, base string"), "m", "s", share).collect()
    want = {(m, s) for m, a in movies for s, b in files if a and b and (a.startswith(b) or b.startswith(a))}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 400


def test_sidecar_query_gives_the_pairs(spark, sf):
    from moteflow.catalog.catalogue import sidecar_matches
    p = [(r.p_partkey, f"{r.p_name}_{r.p_size}", f"{r.p_name}_{str(r.p_size)[:1]}{'1' if r.p_partkey % 3 == 0 else ''}") for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    want = sorted((a, c) for a, m, _ in p for c, _, s in p if m.startswith(s) or s.startswith(m))
    assert sorted(tuple(r) for r in sidecar_matches(spark, sf).select("p_partkey", "ps_key").collect()) == want
