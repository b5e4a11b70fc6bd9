import random
import re

import pytest
from pyspark.sql import functions as F

from stemforge.llm import near_duplicates as nd


def data(n=260):
    rng = random.Random(9)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(rng.randrange(1, 26))] for _ in range(60)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice("xyz") + str(rng.randrange(9))
        rng.shuffle(words)
        rows.append((f"k{i:03d}", " ".join(words).upper() if i % 3 else "-".join(words)))
    rows += [(f"same{i}", "the very same text") for i in range(5)] + [("e1", ""), ("e2", " ?! "), ("nul", None), (None, "the very same text"), ("k000", rows[0][1])]
    return rows


def brute(rows, threshold):
    sets = {}
    for k, t in rows:
        if k is not None and t and (w := frozenset(re.findall(r"[^\W_]+", t.lower()))):
            sets[k] = w
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 1.0])
@pytest.mark.parametrize("small", [None, "common", "rare", "long"])
def test_all_pairs_of_brute_force(spark, threshold, small, monkeypatch):
    if small:  # everything counts as common, or nothing does; tiles are refined and cut into blocks
        monkeypatch.setattr(nd, "TILE", 4)
        monkeypatch.setattr(nd, "BLOCK", 2)
        monkeypatch.setattr(nd, "COMMON_ONE_IN", 1)
        monkeypatch.setattr(nd, "LEAST_COMMON", 2 if small != "rare" else 10_000)
        monkeypatch.setattr(nd, "LONG", 14 if small == "long" else 512)
        monkeypatch.setattr(nd, "WORDS_PER_MAP", 4)
    rows = data()
    df = spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "id string, text string, class string, h int")
    got = {(r["id_a"], r["id_b"]) for r in nd.similar_pairs(df, "id", F.col("text"), threshold).collect()}
    assert got == brute(rows, threshold)


def test_membership_has_one_row_per_key(spark):
    rows = data()
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r["id"]: (r["class_id"], r["n_copies"], r["n_links"]) for r in nd.membership(df, "id", F.col("text"), 0.7).collect()}
    assert got["same3"] == ("same0", 5, 0) and "e1" not in got and "nul" not in got
    pairs = brute(rows, 0.7)
    heads = {k: v[0] for k, v in got.items()}
    for k, (_, _, links) in got.items():
        near = {heads[b if a == k else a] for a, b in pairs if k in (a, b)}
        assert links == len(near - {heads[k]})


def test_empty(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert nd.similar_pairs(df, "id", F.col("text"), 0.7).count() == 0
    with pytest.raises(ValueError):
        nd.similar_pairs(df, "id", F.col("text"), 0.0)


def test_merged_intersection():
    import pyarrow as pa

    rng = random.Random(6)
    pairs = [[sorted(rng.sample(range(-40, 40), rng.randrange(0, 30))) for _ in range(2)] for _ in range(200)]
    kind = pa.list_(pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(range(200)), pa.array([p[0] for p in pairs], kind), pa.array([p[1] for p in pairs], kind)], names=list("abxy"))
    (out,) = nd._shared(iter([batch]))
    assert out.column(2).to_pylist() == [len(set(x) & set(y)) for x, y in pairs] and out.column(3).to_pylist() == [len(set(x) | set(y)) for x, y in pairs]


def test_no_tile_is_compared_beyond_its_bound(spark, monkeypatch):
    import numpy as np

    seen = []

    def entries(tile, n):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(np.full(n, tile)), pa.array(np.full(n, (5 << 4) | 4, np.int32)), pa.array(np.arange(n)), pa.array(np.zeros(n, np.int64))], names=["tile", "packed", "class", "m0"])

    for out in nd._compare(0.7, 10)(iter([entries(1, 3), entries(2, 8), entries(2, 9), entries(2, 1), entries(3, 10), entries(4, 11), entries(5, 1)])):
        seen += [tuple(r.values()) for r in out.to_pylist()]
    assert sorted((a, n) for a, _, n in seen if n) == [(2, 18), (4, 11)]
    assert {(a, b) for a, b, n in seen if not n} == {(a, b) for b in range(10) for a in range(b)}
