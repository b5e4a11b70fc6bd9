import numpy as np
import pytest

from stemforge.llm import packing

KINDS = "kind string, cap int, extra string"


def test_pack_never_overfills_and_leaves_little():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 61, 4000)
    bins = packing.pack(sizes, 100)
    used = np.bincount(bins, weights=sizes)
    assert used.max() <= 100 and 1 - used.sum() / (100 * len(used)) < 0.02


def test_each_step_is_the_smallest_sum_of_squares():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 9, 200)
    gaps: dict[int, int] = {}

    def squares(room):
        counts = np.bincount([g for g in room if 0 < g], minlength=10)
        return int((counts**2).sum())

    for size, number in zip(sizes, packing.pack(sizes, 9)):
        choices = [squares([g - size if b == n else g for b, g in gaps.items()]) for n, gap in gaps.items() if gap >= size]
        choices.append(squares([*gaps.values(), 9 - size]))
        gaps[number] = gaps.get(number, 9) - size
        assert gaps[number] >= 0 and squares(gaps.values()) == min(choices)


@pytest.mark.parametrize("block_items", [50_000, 7])
def test_every_token_lies_in_one_container(spark, block_items):
    rows = [(i, int(s), "z") for i, s in enumerate([0, 5, 10, 11, 25, 30, 3, 3, 3, 7, 0, 1])] + [(None, 4, None), (1, 5, "z"), (77, None, "z")]
    items = spark.createDataFrame(rows, "part long, size int, kind string")
    kinds = spark.createDataFrame([("a", 10, None), ("b", 100, None), ("a", 10, None), ("bad", None, None), ("zero", 0, None)], KINDS)
    got = packing.pack_items(items.withColumnRenamed("part", "key"), "key", "size", kinds, "kind", "cap", block_items).collect()
    for kind, cap in (("a", 10), ("b", 100)):
        mine = [r for r in got if r["kind"] == kind]
        room: dict[str, int] = {}
        for r in mine:
            room[r["container_id"]] = room.get(r["container_id"], 0) + r["n_tokens"]
        assert max(room.values()) <= cap and sum(room.values()) == sum(s or 0 for _, s, _ in rows)
        for key in {r[0] for r in rows}:
            want = sorted(n for k, s, _ in rows if k == key for n in packing.split_sizes(s or 0, cap))
            assert sorted(r["n_tokens"] for r in mine if r["key"] == key) == want
    assert {r["kind"] for r in got} == {"a", "b"}


def test_empty_inputs(spark):
    items = spark.createDataFrame([(1, 5)], "id long, n int")
    kinds = spark.createDataFrame([("a", 10, None)], KINDS)
    assert packing.pack_items(items.limit(0), "id", "n", kinds, "kind", "cap").count() == 0
    assert packing.pack_items(items, "id", "n", kinds.limit(0), "kind", "cap").count() == 0
    report = packing.fill_report(packing.pack_items(items, "id", "n", kinds, "kind", "cap"), kinds, "kind", "cap").first()
    assert (report["n_containers"], report["unused_share"]) == (1, 0.5)


@pytest.mark.parametrize(("n", "most"), [(1000, 0.03), (6000, 0.01)])
def test_blocks_leave_little_room(spark, n, most):
    rng = np.random.default_rng(3)
    rows = [(i, int(s)) for i, s in enumerate(np.minimum(rng.lognormal(4.5, 0.9, n), 5000))]
    items = spark.createDataFrame(rows, "id long, n int")
    kinds = spark.createDataFrame([("small", 512, None), ("large", 2048, None)], KINDS)
    packed = packing.pack_items(items, "id", "n", kinds, "kind", "cap")
    assert packed.selectExpr("split(container_id, '-')[0] AS block").distinct().count() > 1
    report = {r["kind"]: r for r in packing.fill_report(packed.withColumnRenamed("n", "n_tokens") if "n" in packed.columns else packed, kinds, "kind", "cap").collect()}
    assert all(r["unused_share"] < most and r["n_tokens"] == sum(s for _, s in rows) for r in report.values()), report
