"""Counts of endings are those of all rows."""

import pytest
from pyspark.sql import functions as F

from stemforge.llm import endings, pairs, truncation

ODD = ["Ⅷ b²c don't x_y 3,4.5 A. B", "N. N 0", "…", "a\n\nB c D.", "a''b 'c' d’e’f 1..2 1,2,3. 4,", "İstanbul ΣΑΣ wörter 中文字 ・ab\x00c", " ", "\n", "one", "\U0001f916 two. 7th", "_", "x" * 3000 + " y"]


def test_tokens_of_many_texts():
    known = endings._Tokens()
    numbers, stops = endings._numbered(ODD, known)
    raw = {v: k for k, v in known.items()}
    assert [raw[i] for i in numbers.tolist()] == [t for text in ODD for t in endings._TOKEN.findall(text)]
    assert stops.tolist() == [sum(len(endings._TOKEN.findall(t)) for t in ODD[: i + 1]) for i in range(len(ODD))]


def _after_the_sample(spark, n):
    """Numbers under ``n``, smallest hash first: those that a sample by hash would take last come last."""
    return [r[0] for r in spark.range(n).select("id").orderBy(F.xxhash64(F.col("id").cast("string"))).collect()]


@pytest.mark.parametrize("bits", [endings.LEAST_BITS, 6])
def test_answers_are_those_of_all_counts(spark, monkeypatch, bits):
    monkeypatch.setattr(endings, "LEAST_BITS", bits)
    monkeypatch.setattr(endings, "MOST_BITS", max(bits, 6))
    texts = [f"The {w} list holds every node. Then the agent waits for the {w} rob{'ot' if i % 3 else ''}" for i in range(12) for w in ("open", "closed", "long")] + ["see you", "See it\nsee you"] * 4 + ["The list " + "o" * 30 + "p of it. The list " + "o" * 30 + "p of it. See the " + "o" * 30] + ODD
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    model = endings.fit(df, F.col("t"))
    asked = {q.id: q for q in map(endings.question, texts) if q}
    # a long word is asked for by itself, as that of an answer
    single = endings.Question(endings.contexts(["o" * 30], 1), None, "o" * 30)
    asked[single.id] = single
    table = spark.createDataFrame([endings.asked_fields(q) for q in asked.values()] + [(None, None, None, None)], endings.ASKED)
    found, usual = endings.chances(table, df, F.col("t"))
    got = {r["question"]: (r["chance"], r["broken"]) for r in found.collect()}
    assert usual == model.usual and set(got) == set(asked)
    for i, q in asked.items():
        assert got[i] == (pytest.approx(model.answer(q)), q.word is not None and not model.knows(q.word) and model.begins_longer(q.word))
    assert sum(b for _, b in got.values()) == 2


def test_defects_count_all_rows(spark):
    order = _after_the_sample(spark, 12_400)
    answers = dict.fromkeys(order, "It reads the qarlon of the list.") | {i: "It reads the qar of the list." for i in order[-300:]} | {order[0]: "the open qar", order[1]: "the open qarl"}
    df = spark.createDataFrame([(i, "Which one?", None, a, "The qarlon waits.", "cloze") for i, a in answers.items()], "id long, stem string, options array<string>, answer string, explanation string, qtype string")
    got = pairs.find_defects(df, "id", "stem", "options", "answer", "explanation", "qtype").collect()
    assert [tuple(r) for r in got] == [(order[1], "truncated")]


def test_truncation_counts_all_rows(spark):
    order = _after_the_sample(spark, 4400)
    texts = dict.fromkeys(order, "The robot reads the qarlon of the list. Then the agent waits.") | {i: "The robot reads the qar of it. We saw the qar.\nWe keep the qar\nThen the agent waits." for i in order[-300:]}
    texts |= {order[0]: "Then it ends. A long closed list that waits holds the qar", order[1]: "Then it ends. One short open list that stays keeps the qarl"}
    df = spark.createDataFrame(list(texts.items()), "doc long, body string").withColumn("origin", F.lit("a"))
    got = truncation.find_truncated(df, "doc", "body", "origin").where("is_cut").select("doc", "evidence").collect()
    assert [tuple(r) for r in got] == [(order[1], "0.001")]
