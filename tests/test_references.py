import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stemforge.operators.references import find_orphans, orphan_report, split_ids

REFS = "rid int, a string, b int, at timestamp"
TARGETS = "a string, b int, since timestamp, until timestamp"


def day(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def rows(df):
    return sorted((r["rid"], r["reason"]) for r in df.collect())


def test_split_ids(spark):
    fields = [("A1, a2;a1",), ('["x", "Y"]',), (" \n",), (None,), ("p|q 'r'",), ("",)]
    got = [r[0] for r in spark.createDataFrame(fields, "f string").select(split_ids(F.col("f"))).collect()]
    assert got == [["a1", "a2"], ["x", "y"], [], [], ["p", "q", "r"], []]


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_null_masks_against_brute_force(spark, match):
    rng = random.Random(3)
    refs = [(i, rng.choice(["x", "y", "z", None]), rng.choice([1, 2, 3, None]), None) for i in range(120)]
    targets = [(rng.choice(["x", "y", None]), rng.choice([1, 2, None]), None, None) for _ in range(5)] + [("x", 1, None, None)] * 2

    def orphan(a, b):
        if a is None and b is None:
            return None
        if None in (a, b) and match != "partial":
            return "partly_null" if match == "full" else None
        hit = any((a is None or t[0] == a) and (b is None or t[1] == b) for t in targets)
        return None if hit else "missing"

    want = sorted((i, orphan(a, b)) for i, a, b, _ in refs if orphan(a, b))
    got = find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS), {"a": "a", "b": "b"}, match)
    assert rows(got) == want


def test_times_against_brute_force(spark):
    rng = random.Random(5)
    targets = []
    for _ in range(60):
        begin = rng.randrange(30)
        targets.append((rng.choice("pqrs"), 1, day(begin), day(rng.choice([None, begin, begin + 3, begin + 9, begin - 2]))))
    refs = [(i, rng.choice("pqrst"), 1, day(rng.randrange(-3, 45))) for i in range(300)]

    def reason(a, at):
        own = [t for t in targets if t[0] == a]
        if not own:
            return "missing"
        if any(t[2] <= at and (t[3] is None or at < t[3]) for t in own):
            return None
        return "late" if all(t[2] > at for t in own) else "deleted"

    want = sorted((i, reason(a, at)) for i, a, _, at in refs if reason(a, at))
    got = find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS), {"a": "a"}, at="at", valid_from="since", valid_to="until")
    assert rows(got) == want


def test_hot_key_is_split_and_whole(spark):
    refs = spark.range(6000).selectExpr("cast(id as int) rid", "if(id % 3 = 0, 'hot', concat('k', id)) a", "1 b", "cast(null as timestamp) at")
    targets = spark.createDataFrame([("hot", 1, None, None), ("k1", 1, None, None)], TARGETS)
    assert find_orphans(refs, targets, {"a": "a"}).count() == 6000 - 2000 - 1


def test_repeated_rows_clashing_names_empty_tables(spark):
    refs = spark.createDataFrame([(1, "x", 9), (1, "x", 9), (2, None, 9)], "_row int, reason string, _from int")
    targets = spark.createDataFrame([("y", 1)], "reason string, _salt int")
    got = find_orphans(refs, targets, {"_row": "_salt"}).collect()
    assert [(r["_row"], r["_from"], r["reason"]) for r in got] == [(2, 9, "missing")]
    assert find_orphans(refs.limit(0), targets, {"_row": "_salt"}).count() == 0
    assert find_orphans(refs, targets.limit(0), {"_row": "_salt"}).count() == 2
    with pytest.raises(ValueError):
        find_orphans(refs, targets, {"_row": "_salt"}, match="some")


def test_report(spark):
    refs = spark.createDataFrame([(1, "x", 1, None), (2, "y", 1, None), (3, "y", 2, None)], REFS)
    orphans = find_orphans(refs, spark.createDataFrame([("x", 1, None, None)], TARGETS), {"a": "a"})
    got = {r["b"]: (r["n_references"], r["n_missing"], r["n_orphans"]) for r in orphan_report(orphans, refs, ["b"]).collect()}
    assert got == {1: (2, 1, 1), 2: (1, 1, 1)}


def test_every_table_is_read_once(spark, tmp_path):
    refs, targets = str(tmp_path / "refs"), str(tmp_path / "targets")
    spark.createDataFrame([(1, "a", None, 3), (2, None, 2, None), (3, "b", 9, 1)], "id int, x string, y int, z int").write.parquet(refs)
    spark.createDataFrame([("a", 1, 3), ("b", 2, None)], "x string, y int, z int").write.parquet(targets)
    found = find_orphans(spark.read.parquet(refs), spark.read.parquet(targets), {c: c for c in "xyz"}, match="partial")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # what is read twice is the written list of references; their table is no part of the plan, the targets are once
    files = found.inputFiles()
    assert plan.count("Relation") == 4 and not any(refs in f for f in files) and any(targets in f for f in files) and plan.count("Join") == 3
    assert sorted(r["id"] for r in found.collect()) == [3]
