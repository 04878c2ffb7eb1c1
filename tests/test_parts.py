import pytest
from pyspark.sql import functions as F

from moteflow.sources import parts as P

ROW = "v int"


def table(spark, rows):
    return spark.createDataFrame(rows, "part string, v int")


def stamps(spark, **s):
    return spark.createDataFrame(list(s.items()), "part string, stamp string")


def held(spark, store):
    return sorted((r.part, r.v) for r in P.read_parts(spark, store, ROW).collect())


def test_stale_parts_are_replaced_and_others_stay(spark, tmp_path):
    store = str(tmp_path / "s")
    assert held(spark, store) == [] and P.read_manifest(spark, store).count() == 0
    P.replace_parts(table(spark, [("a", 1), ("a", 2), ("b/x y", 3)]), stamps(spark, **{"a": "1", "b/x y": "1", "empty": "1"}), store)
    assert held(spark, store) == [("a", 1), ("a", 2), ("b/x y", 3)]
    want = stamps(spark, **{"a": "2", "b/x y": "1", "c": "1", "empty": "1"})
    assert sorted(r.part for r in P.stale_parts(want, store).collect()) == ["a", "c"]
    P.replace_parts(table(spark, [("a", 9), ("c", 4)]), stamps(spark, a="2", c="1"), store)
    assert held(spark, store) == [("a", 9), ("b/x y", 3), ("c", 4)]
    P.replace_parts(table(spark, []), stamps(spark, a="3"), store)
    assert held(spark, store) == [("b/x y", 3), ("c", 4)] and P.stale_parts(stamps(spark, a="3"), store).count() == 0
    assert P.drop_unused(spark, store) == [] and held(spark, store) == [("b/x y", 3), ("c", 4)]
    P.replace_parts(table(spark, [("b/x y", 5), ("c", 6)]), stamps(spark, **{"b/x y": "2", "c": "2"}), store)
    assert len(P.drop_unused(spark, store)) == 1 and held(spark, store) == [("b/x y", 5), ("c", 6)]


def test_a_killed_writer_changes_nothing(spark, tmp_path):
    store = str(tmp_path / "s")
    P.replace_parts(table(spark, [("a", 1)]), stamps(spark, a="1"), store)
    broken = table(spark, [("a", 2)]).withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        P.replace_parts(broken, stamps(spark, a="2"), store)
    assert held(spark, store) == [("a", 1)] and P.stale_parts(stamps(spark, a="2"), store).count() == 1
    with pytest.raises(ValueError):
        P.replace_parts(table(spark, [("b", 2)]), stamps(spark, a="2"), store)
    assert held(spark, store) == [("a", 1)]


def test_the_second_of_two_writers_is_refused(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "s")
    P.replace_parts(table(spark, [("a", 1)]), stamps(spark, a="1"), store)
    real = P._last
    monkeypatch.setattr(P, "_last", lambda spark, s: 0 if s == store else real(spark, s))
    with pytest.raises(RuntimeError):
        P.replace_parts(table(spark, [("a", 2)]), stamps(spark, a="2"), store)
    monkeypatch.setattr(P, "_last", real)
    assert held(spark, store) == [("a", 1)]
