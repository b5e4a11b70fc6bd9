"""Values of the self-join by prefix are cut once in every text, and what brings them together loses none."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemforge.llm import endings, nesting, truncation

TEXTS = ["The table lists it. Then the agent waits! b) We return\r\n- * 12) the “list”.", "Plan ahead. Plan", "第一步检查规则库。然后结束", None, "", " \n", "wörter (zu", "The table lists. The table", "ab\U0001f916cd ef", "x" * 90 + " y. " + "x" * 90, "See it [...]", "3) [see…]\nWe read (it)..."]


def _values_of(text):
    """As documented: cut behind stops, without signs and list marks before, without signs behind."""
    for piece in re.split(r"(?:(?<=[.!?]) |(?<=[。！？])|\n|\r)", text):
        bare = piece.lstrip(truncation._BEFORE)
        yield re.sub(r"\A(?:.|..)\) ", "", bare, flags=re.DOTALL).rstrip(truncation._BEHIND)


def _met(spark, tails):
    keys = spark.createDataFrame([(t,) for t in tails], "value string").mapInArrow(truncation._longest_heads, "value string, key long").select("key")
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").repartition(3)
    met = truncation._met_values(df, F.col("t"), endings.key_filter(keys, len(tails), truncation.HEAD_BITS))
    return {r[0]: r[1] for r in met.groupBy("value").agg(F.sum("places")).collect()}


def test_values_meet_once_whatever_their_heads(spark):
    want = Counter(v for t in TEXTS if t for v in _values_of(t) if len(v) >= truncation.HEADS[0])
    assert want["The table"] == 1 and want["the “list"] == 1 and want["We return"] == 1
    assert _met(spark, list(want)) == want
    tails = ["Then", "The table", "ab\U0001f916cd", "第一步检查", "x" * 90]
    got = _met(spark, tails)
    assert {v: n for v, n in want.items() if any(v.startswith(t) for t in tails)}.items() <= got.items() and "wörter (zu" not in got


def test_heads_are_the_same_wherever_a_value_stands():
    values = ["Then", "The table lists", "", "x", "Then the agent", "第一步检查规则库", "x" * 90]
    for n, (has, keys) in zip(truncation.HEADS, truncation._heads(values)):
        assert [values[i] for i in has] == [v for v in values if len(v) >= n]
        for i, k in zip(has.tolist(), keys.tolist()):
            assert [k] == next(own for m, (_, own) in zip(truncation.HEADS, truncation._heads([values[i][:n]])) if m == n).tolist()


@pytest.mark.parametrize(("text", "value"), [("See it [...]", "See it"), ("We read (it)...", "We read (it"), ("One. b) two three\n\n", "two three"), ("a\n12) the “list”.", "the “list"), ("Now�", "Now"), ("", ""), ("...", ""), ("规则。第一", "第一")])
def test_last_value(spark, text, value):
    assert truncation._last_value(text) == value
    assert [r[0] for r in spark.createDataFrame([(text,), (None,)], "t string").coalesce(1).select(truncation.last_value(F.col("t"))).collect()] == [value, None]


def test_lines_that_begin_no_sign_cost_the_parser_nothing(monkeypatch):
    class Counted:
        def __init__(self, sign):
            self.sign, self.n = sign, 0

        def match(self, *at):
            self.n += 1
            return self.sign.match(*at)

    seen = Counted(nesting._SIGN)
    monkeypatch.setattr(nesting, "_SIGN", seen)
    assert nesting.parse("\n".join(f"{i}.{i} Open list of the agent" for i in range(500))) == [] and seen.n == 0
    assert [s.kind for s in nesting.parse("a\nb\n12) x\n  (c\n")] == ["bracket"] and seen.n > 0


def test_tokens_of_a_task_become_numbers_once():
    known = endings._Tokens()
    for texts in (["The open list."], ["The Closed list, 7"]):
        endings._numbered(texts, known)
        hashes, kinds, capital = known.arrays()
        assert hashes.tolist() == known.hashes and kinds.tolist() == known.kinds and capital.tolist() == known.capital
    assert known.arrays()[0].dtype == np.uint64
