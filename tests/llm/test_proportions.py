import random

import pytest

from stemforge.llm import proportions as p

BLUEPRINTS = [
    ("a", '{"bank_id": "b1", "total_questions": 10, "min_per_category": 2, "difficulty": {"Easy": 50, "hard ": 50, "none": 0}, "chapters": {" 2": 1}}'),
    ("a", '{"bank_id": "b1", "total_questions": 10, "min_per_category": 2, "difficulty": {"Easy": 50, "hard ": 50, "none": 0}, "chapters": {" 2": 1}}'),
    ("b", '{"bank_id": "b1", "total_questions": 3, "difficulty": {"easy": 0.2, "EASY": 0.1, "hard": 0.7}}'),
    ("c", None), ("d", ""), ("e", '{"bank_id": "b1", "total_questions": 5, "difficulty": {"easy"'), ("f", "[1]"), ("g", '{"bank_id": "b1", "difficulty": {"easy": 1}}'), ("h", '{"total_questions": 5, "difficulty": {"easy": 1}}'),
    ("k", '{"bank_id": "b1", "total_questions": 4, "min_per_category": 1.5, "difficulty": {"easy": 1, "hard": 0}}'), ("k", '{"bank_id": "b1", "total_questions": 6, "difficulty": {"easy": 1, "hard": 1}}'),
    ("i", '{"bank_id": "zz", "total_questions": 4, "bloom_level": {"apply": "100%"}, "difficulty": null}'), ("j", '"text"'),
]


def test_allocation_sums_and_bounds():
    assert p.allocate([50, 50, 0], [9, 9, 9], 10, 0) == [5, 5, 0]
    assert p.allocate([1, 1, 1], [9, 9, 9], 10, 0) == [4, 3, 3]
    assert p.allocate([90, 10], [3, 9], 10, 0) == [3, 7]
    assert p.allocate([97, 3], [99, 99], 10, 2) == [8, 2]
    assert p.allocate([1, 1], [0, 1], 10, 3) == [0, 1]
    assert p.allocate([], [], 10, 1) == []
    rng = random.Random(1)
    for _ in range(500):
        n = rng.randrange(1, 7)
        w, top = [rng.choice([0, 1, 2.5, 40]) for _ in range(n)], [rng.randrange(12) for _ in range(n)]
        total, floor = rng.randrange(30), rng.randrange(4)
        got = p.allocate(w, top, total, floor)
        low = [min(floor, t) for t in top]
        assert all(lo <= g <= t for lo, g, t in zip(low, got, top))
        room = sum(t if x > 0 or not any(w) else lo for x, t, lo in zip(w, top, low))
        assert sum(got) == max(sum(low), min(total, room)) or sum(got) <= max(total, sum(low))


def frames(spark):
    quizzes = spark.createDataFrame([(q, b, 1, "x") for q, b in BLUEPRINTS], "quiz_id string, blueprint string, weight int, category string")
    rows = [(f"q{i}", "b1", "easy" if i % 3 else " HARD", 2 if i % 2 else None) for i in range(12)] + [("q0", "b1", "hard", None), ("x", None, "easy", 2), (None, "b1", "easy", 2), ("y", "b1", None, 3)]
    return quizzes, spark.createDataFrame([(*r, "g") for r in rows], "id string, bank_id string, difficulty string, chapter int, group string")


def allocated(spark):
    quizzes, items = frames(spark)
    targets = p.blueprint_targets(quizzes)
    dims = {"difficulty": "difficulty", "chapters": "chapter", "bloom_level": "difficulty"}
    return p.quotas(targets, p.count_categories(items, "bank_id", "id", dims)), p.members(items, "bank_id", "id", dims)


def test_needs_and_shortfalls(spark):
    rows = allocated(spark)[0].collect()
    # a quiz that came with two blueprints has both; a fractional floor is the next whole number
    assert sorted((r["total"], r["category"], r["needed"], r["quota"]) for r in rows if r["sample"] == "k") == [(4.0, "easy", 4, 2), (4.0, "hard", 2, 2), (6.0, "easy", 3, 3), (6.0, "hard", 3, 3)]
    got = {(r["sample"], r["dimension"], r["category"]): (r["needed"], r["available"], r["quota"], r["shortfall"]) for r in rows if r["sample"] != "k"}
    assert got == {
        ("a", "difficulty", "easy"): (5, 8, 6, 0), ("a", "difficulty", "hard"): (5, 4, 4, 1), ("a", "difficulty", "none"): (2, 0, 0, 2), ("a", "chapters", "2"): (10, 6, 6, 4),
        ("b", "difficulty", "easy"): (1, 8, 1, 0), ("b", "difficulty", "hard"): (2, 4, 2, 0), ("i", "bloom_level", "apply"): (4, 0, 0, 4),
    }


def test_draw_takes_the_smallest_keys(spark):
    import hashlib

    quota, people = allocated(spark)
    got = {}
    for r in p.draw(quota.where("sample <> 'k'"), people, seed=3).collect():
        got.setdefault((r["sample"], r["dimension"], r["category"]), set()).add(r["key"])
    order = sorted((f"q{i}" for i in range(12) if i % 3), key=lambda k: hashlib.md5(f"3:{k}".encode()).hexdigest())
    assert got[("a", "difficulty", "easy")] == set(order[:6]) and got[("b", "difficulty", "easy")] == set(order[:1])
    assert {k: len(v) for k, v in got.items()} == {("a", "difficulty", "easy"): 6, ("a", "difficulty", "hard"): 4, ("a", "chapters", "2"): 6, ("b", "difficulty", "easy"): 1, ("b", "difficulty", "hard"): 2}


def test_empty(spark):
    quizzes, items = frames(spark)
    targets = p.blueprint_targets(quizzes.limit(0))
    assert p.quotas(targets, p.count_categories(items.limit(0), "bank_id", "id", {"difficulty": "difficulty"})).count() == 0


def many(spark, n=6000):
    import random

    rng = random.Random(2)
    rows = [(f"q{i}", "b", rng.choice(["easy"] * 8 + ["hard"]), rng.randrange(1, 5), rng.choice(["apply", "create", None])) for i in range(n)]
    quizzes = [("one", '{"bank_id": "b", "total_questions": 40, "difficulty": {"easy": 1, "hard": 1}, "chapters": {"1": 2, "2": 1, "3": 1}}'), ("two", '{"bank_id": "b", "total_questions": 900, "difficulty": {"hard": 1}, "bloom_level": {"apply": 1}}'), ("none", '{"bank_id": "z", "total_questions": 3, "difficulty": {"hard": 1}}')]
    return rows, spark.createDataFrame(rows, "id string, bank string, d string, c int, l string"), spark.createDataFrame(quizzes, "quiz_id string, blueprint string")


DIMS = {"difficulty": "d", "chapters": "c", "bloom_level": "l"}


@pytest.mark.parametrize("slack", [True, False])
def test_draw_behind_a_threshold(spark, monkeypatch, slack):
    import hashlib

    if not slack:  # thresholds that let too few pass
        monkeypatch.setattr(p, "SLACK", 0.3)
        monkeypatch.setattr(p, "SPARE", 0)
    rows, items, quizzes = many(spark)
    targets = p.blueprint_targets(quizzes)
    quota = p.quotas(targets, p.count_categories(items, "bank", "id", DIMS))
    got: dict = {}
    for r in p.draw(quota, p.members(items, "bank", "id", DIMS)).collect():
        got.setdefault((r["sample"], r["dimension"], r["category"]), []).append((r["draw_rank"], r["key"]))
    for r in quota.collect():
        at = {"difficulty": 2, "chapters": 3, "bloom_level": 4}[r["dimension"]]
        known = sorted((hashlib.md5(f"1:{x[0]}".encode()).hexdigest()[:13], x[0]) for x in rows if str(x[at]) == r["category"] and r["group"] == "b")
        assert r["quota"] <= len(known) == r["available"]
        assert sorted(got.get((r["sample"], r["dimension"], r["category"]), [])) == [(i, k) for i, (_, k) in enumerate(known[: r["quota"]], 1)]


def test_one_set_for_all_dimensions(spark):
    rows, items, quizzes = many(spark)
    targets = p.blueprint_targets(quizzes)
    quota = p.quotas(targets, p.count_categories(items, "bank", "id", DIMS))
    drawn, report = p.draw_jointly(quota, items, "bank", "id", DIMS)
    keys: dict = {}
    for r in drawn.collect():
        keys.setdefault(r["sample"], []).append(r["key"])
    assert len(keys["one"]) == len(set(keys["one"])) == 40 and "none" not in keys
    of = {x[0]: x for x in rows}
    told = {(r["sample"], r["dimension"], r["category"]): (r["quota"], r["drawn"], r["missed"]) for r in report.collect()}
    for (sample, dimension, category), (want, n, missed) in told.items():
        at = {"difficulty": 2, "chapters": 3, "bloom_level": 4}[dimension]
        assert n == sum(str(of[k][at]) == category for k in keys.get(sample, [])) and missed == max(want - n, 0)
        if sample == "one":
            assert abs(want - n) <= 2
    assert p.draw_jointly(quota.limit(0), items, "bank", "id", DIMS)[0].count() == 0
