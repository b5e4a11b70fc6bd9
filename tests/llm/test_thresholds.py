"""How low a chance must be for a cut is taken from the counts of all texts."""

import pytest
from pyspark.sql import functions as F

from stemforge.llm import truncation

CUT = truncation.LIKELY / (1 - truncation.LIKELY)
LOW, HIGH = truncation.STEPS[0], truncation.STEPS[-1]


def test_thresholds_follow_the_chances_of_cut_texts():
    cuts = {LOW: 900, -4: 60, -1: 20, HIGH: 20}
    # of some 45 cut texts all but the last ones stand before step -1, where whole ones begin; of options these begin at step -4
    found = truncation.thresholds({CUT: cuts, 0.4: {LOW: 41, -4: 3, -1: 30, 0: 300, HIGH: 1626}, 0.05: {LOW: 14, -4: 20, -1: 90, HIGH: 700}, 9.0: {LOW: 90, -4: 6, -1: 2, HIGH: 2}}, CUT)
    assert found == {0.4: 2**-1.5, 0.05: 2.0 ** ((LOW + 1) / 2), 9.0: float("inf")}
    assert truncation.thresholds({CUT: {LOW: truncation.LEAST_CUTS - 1}, 0.4: {0: 5}}, CUT) == {} == truncation.thresholds({}, CUT)
    assert truncation.thresholds({CUT: cuts, 0.4: {HIGH: 50}}, CUT)[0.4] < 2.0**HIGH


def test_no_threshold_is_fixed_where_texts_at_limits_tell_it(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(truncation, "LEAST_CUTS", 5)
    monkeypatch.setattr(truncation, "thresholds", lambda counts, cut, own=truncation.thresholds: seen.update(counts=counts, found=own(counts, cut)) or seen["found"])
    words = ["The open list holds every node that waits.", "A closed list holds the nodes that are done.", "Because the list is short, the agent waits for the robot."]
    rows = [(i, " ".join(words[(i + j) % 3] for j in range(1 + i % 4)), "a") for i in range(60)]
    rows += [(100 + i, ("x%d " % i + " ".join(words[(i + j) % 3] for j in range(3)))[:90], "b") for i in range(24)]
    rows += [(200, "Then it starts. Now we see it. A closed list that waits holds every", "a"), (201, "Then it starts. Some other robot has done it for the agent waits", "a")]
    df = spark.createDataFrame(rows, "doc long, body string, origin string")
    judged = truncation.find_truncated(df, "doc", "body", "origin")
    got = {r["doc"] for r in judged.where("is_cut").collect()}
    # all texts that the chance decides are counted, and only these
    kinds = {round(k, 2): sum(n.values()) for k, n in seen["counts"].items()}
    assert set(seen["found"]) == set(seen["counts"]) - {CUT} and kinds[round(CUT, 2)] >= 5
    assert 200 in got and judged.count() == len(rows)
    assert {i for i in range(60)} & got == set()
    monkeypatch.setattr(truncation, "thresholds", lambda *_: {k: 0.0 for k in seen["counts"]})
    none = {r["doc"] for r in truncation.find_truncated(df, "doc", "body", "origin").where("is_cut and evidence not in ('prefix')").collect()}
    assert 200 not in none
