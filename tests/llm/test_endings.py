import pytest
from pyspark.sql import functions as F

from stemforge.llm import endings, nesting, pairs, tiling, truncation
from stemforge.llm.languages import differs, language

SENTENCES = ["The open list holds every node that waits.", "A closed list holds the nodes that are done.", "The table below lists what the agent keeps in each round.", "Because the list is short, the agent waits for the robot.", "Then the robot reads the rule and the agent reads the table."]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, " ".join(SENTENCES[(i + j) % 5] for j in range(3))) for i in range(60)] + [(100 + i, SENTENCES[i % 5] + "\nsee you tomorrow") for i in range(8)]
    return endings.fit(spark.createDataFrame(rows, "i int, t string"), F.col("t"), F.col("i"))


@pytest.mark.parametrize(
    ("text", "cut"),
    [
        (SENTENCES[0], False), ("", False), (" \n", False), ("Then the robot reads the rule. The open list holds every", True), ("Then the robot waits. A closed list holds the nod", True), ("The open list holds every node that waits", False), ("Then it ends. The table be…", True), ("Then the robot reads the [...]", True),
        ("Fine, the robot reads the rule.\nhmm...", False), (SENTENCES[1] + "\nsee you tomorrow", False), ('{"a": [1, 2', True), ('{"a": [1, 2]}', False), ('{"a": "}', True), ("```py\nx = 1\n```", False), ("```py\nx = 1", True), ("The list (see the", True),
        ("Open List", False), ("The robot reads the rule, ", True), ("Is it “the open", True), ("It is “the open list”", False), ("Done. 🤖", False), ("1.1 Lists ........ 7\n1.2 Rules ......", True), ("Well, wait ......", False), ("Some tools, e.g.", True), ("It reads one, two, etc.", False), ("� the robot reads the �", True),
    ],
)
def test_judge(model, text, cut):
    assert endings.judge(text, model).cut is cut


WIDE = ["规划器在第三步之后改变计划。", "评估函数过于粗糙时，智能体会绕远路。", "知识库里的规则必须逐条检查。"]


def test_lines_without_blanks_are_no_titles(spark):
    rows = [(i, "".join(WIDE[(i + j) % 3] for j in range(3))) for i in range(60)]
    wide = endings.fit(spark.createDataFrame(rows, "i int, t string"), F.col("t"), F.col("i"))
    text = "".join(WIDE * 8)
    assert len(text.split()) == 1
    assert endings.judge(text + "评估函数过于粗糙时，智能体会", wide).cut and not endings.judge(text, wide).cut
    assert endings.judge("评估函数过于粗糙时，智能体会绕...", wide).cut and not endings.judge("嗯...", wide).cut
    assert endings.judge("评估函数过于", wide).why == "title" and endings.judge("智能体 Brexaer", wide).why == "title"
    assert pairs.is_truncated(text + "评估函数过于粗糙时，智能体会", wide, True) and not pairs.is_truncated("评估函数", wide, True)
    assert [endings.n_words(t) for t in ("", "a list, of - nodes", "规划器", "规划器在", "第3步 Brexaer、")] == [0, 5, 1, 2, 3]


def test_empty_model():
    import numpy as np

    nothing = endings.Endings(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), [])
    assert endings.judge("any text at all without an end", nothing).cut in (True, False)


def test_strict_prefixes_against_brute_force(spark):
    import random

    rng = random.Random(3)
    texts = sorted({"".join(rng.choice("ab ") for _ in range(1 + rng.randrange(8))) for _ in range(90)} | {"short", "shorter", "g" * 70, "g" * 71, "ü", "üb"})
    df = spark.createDataFrame([(t, i % 2 == 0) for i, t in enumerate(texts)], "value string, asked boolean").repartition(7)
    after = lambda t: min((u for u in texts if u != t and u.startswith(t)), key=str.encode, default=None)
    want = {(t, after(t)[len(t)]) for t in texts[::2] if after(t)}
    assert {tuple(r) for r in truncation.strict_prefixes(df).collect()} == want


@pytest.mark.parametrize("small", [True, False])
def test_values_that_begin_longer_ones(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(truncation, "BROADCAST_ROWS", -1)
    whole = ["The table lists what the agent keeps. Then the agent waits for the robot!\n- We return the list.", "Plan ahead. Plan", "- Ende gut.\nAlles gut", "第一步检查规则库。然后结束", None, "", "  ", "7\n7\n7"]
    tails = ["The table lists what the ag", "Then the agent", "We retu", "Plan", "第一步检查规", "nowhere else", "We", "", "7"]
    docs = spark.createDataFrame([(t,) for t in whole + tails], "body string")
    asked = spark.createDataFrame([(t,) for t in tails] + [("Plan",), (None,)], "t string").select(truncation.last_value(F.col("t")).alias("tail"))
    found = {r["tail"]: (r["proof"], r["longer"]) for r in truncation.broken_values(docs, "body", asked).collect()}
    code = lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0]
    assert found == {code("The table lists what the ag"): (True, True), code("Then the agent"): (False, True), code("We retu"): (True, False), code("第一步检查规"): (False, True), code("Plan"): (False, False)}


def test_find_truncated(spark):
    whole = [(i, " ".join(SENTENCES[(i + j) % 5] for j in range(1 + i % 4)), "a") for i in range(40)]
    limit = [(100 + i, ("x%d " % i + SENTENCES[i % 5] + " " + SENTENCES[(i + 2) % 5] + " " + SENTENCES[(i + 3) % 5])[:90], "b") for i in range(10)]
    odd = [(200, None, "a"), (201, "", None), (202, "  ", "b"), (203, SENTENCES[0], None), (None, "Then the robot reads the rule and the agent reads the", "a"), (0, whole[0][1], "a"), (204, "word. " * 40_000, "a")]
    copies = [(300, SENTENCES[2] + " " + SENTENCES[3] + " The agent", "c"), (301, SENTENCES[2] + " " + SENTENCES[3] + " The agent waits for the table.", "c")]
    df = spark.createDataFrame([(*r, "z", 1) for r in whole + limit + odd + copies], "doc long, body string, origin string, text string, key int")
    judged = truncation.find_truncated(df, "doc", "body", "origin")
    got = {r["doc"] for r in judged.where("is_cut").collect()}
    ends = {i for i, t, _ in limit if not t.rstrip().endswith(".")}
    assert got == ends | {None, 300} and judged.count() == df.count() and judged.columns == ["doc", "origin", "is_cut", "evidence"]
    report = {r["origin"]: r["n_cut"] for r in truncation.truncation_report(judged, "origin").collect()}
    assert report == {"a": 1, "b": len(ends), "c": 1, None: 0}
    assert truncation.find_truncated(df.limit(0), "doc", "body", "origin").count() == 0


def test_limits_are_an_excess_over_neighbouring_lengths(spark):
    import random

    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n - 1)) + "x"
    measures = lambda rows: spark.createDataFrame(rows, "source string, t string").select("source", F.length("t").alias("chars"), F.octet_length("t").alias("bytes"), F.xxhash64(F.right("t", F.lit(32))).alias("end"))
    rows = [("feed", text(rng.randrange(200, 900))) for _ in range(600)] + [("feed", text(1000)) for _ in range(6)]
    rows += [("tape", text(rng.randrange(200, 1800))) for _ in range(250)] + [("tape", text(256 * k)) for k in (1, 2, 3, 4, 6) for _ in range(4)]
    # 2 % of the texts at every length, which is no more than the neighbours have; copies; texts of one form
    rows += [("titles", text(rng.randrange(30, 80))) for _ in range(300)] + [("copies", text(rng.randrange(200, 900))) for _ in range(300)] + [("copies", "c" * 950)] * 40
    rows += [("form", text(rng.randrange(200, 900))) for _ in range(300)] + [("form", f"{i:04}" + "f" * 946) for i in range(40)]
    found = {tuple(r) for r in truncation.field_limits(measures(rows)).collect()}
    assert {("feed", "chars", 1000), *(("tape", "bytes", 256 * k) for k in (1, 2, 3, 4, 6))} <= found
    assert {r[0] for r in found} == {"feed", "tape"} and {r[2] for r in found if r[0] == "feed"} == {1000} and all(r[2] % 256 == 0 for r in found if r[0] == "tape")
    assert truncation.field_limits(measures([])).count() == 0


@pytest.mark.parametrize(("text", "name"), [("The list is empty and the agent waits", "en"), ("Der Agent wartet auf die leere Liste", "de"), ("La liste est vide et l'agent attend dans une file", "fr"), ("La lista no está vacía porque el agente espera", "es"), ("知识库里的规则", "zh"), ("規則は必ず確かめる", "ja"), ("Klazan Brero", None), ("42", None), ("", None)])
def test_language(text, name):
    assert language(text) == name


def test_quoted_terms_are_no_other_language():
    assert not differs("The older notes call it “die Bewertungsfunktion der Liste”.", "What is the name of the list?")
    assert differs("Es ist die Liste der Knoten.", "What is the name of the list?") and not differs("Klazan", "What is the name of the list?")


@pytest.mark.parametrize("text", ["I'm sorry, but I can't help with that.", "As an AI assistant, I must decline this request.", "No answer can be given by me.", "You will need to ask a teacher instead.", "Es tut mir leid, dabei kann ich nicht helfen.", "Lo siento, no puedo ayudar.", "The question is about trees. I cannot answer this question.", "Sorry.", "Unfortunately, " * 40 + "I cannot answer this question.", "Thanks for asking. " * 30 + "We won't be able to help.", "抱歉，我无法回答。", "申し訳ありません。お答えできません。", "Je suis désolé, je ne peux pas répondre.", "My guidelines keep me from replying; please rephrase it."])
def test_refusals(text):
    assert pairs.is_refusal(text)


@pytest.mark.parametrize("text", ["The agent says “sorry” to the user, yet it moves.", "Here Klazan cannot answer the query.", "The model is unable to expand the list.", "No", "Well", "I cannot be in two rooms at once.", "It is outside the list.", "", "?", "Because I comes before J.", "A"])
def test_no_refusals(text):
    assert not pairs.is_refusal(text)


STEM = "In the maze of Brero, a robot moves ten steps. Which list does the robot read first when it waits?"


@pytest.mark.parametrize(("text", "copied"), [(STEM, True), (STEM.upper(), True), ("Answer: " + STEM, True), (STEM + " " + STEM, True), ("Which list does the robot read first when it waits?", True), (STEM.replace("ten ", ""), True), ("the robot", False), (STEM + " It reads the open list, since that one holds all nodes which are still to be looked at.", False), ("It reads the open list first.", False), ("", False)])
def test_copies(text, copied):
    assert pairs.is_copy(text, STEM) is copied


def test_tiles_are_disjoint_and_longest_first():
    found = tiling.tiles("a b c d e f g h".split(), "x c d e f y a b c z g h".split(), 2)
    assert found == [(2, 1, 4), (0, 6, 2), (6, 10, 2)]


def test_tiles_against_brute_force():
    import random

    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(14))] for _ in range(2))
        lengths, ends = tiling.longest_matches(a, b)
        for i in range(len(a)):
            n = next(n for n in range(i + 1, -1, -1) if any(a[i + 1 - n : i + 1] == b[j : j + n] for j in range(len(b) - n + 1)))
            assert lengths[i] == n and b[ends[i] - n : ends[i]] == a[i + 1 - n : i + 1]
        laid = tiling.tiles(a, b, 2)
        places = [p for i, _, n in laid for p in range(i, i + n)]
        assert len(places) == len(set(places)) and all(a[i : i + n] == b[j : j + n] and n >= 2 for i, j, n in laid) and [t[2] for t in laid] == sorted((t[2] for t in laid), reverse=True)
        # no run of two words that the text holds is left free
        assert not any(p not in places and p + 1 not in places and lengths[p + 1] >= 2 for p in range(len(a) - 1))


@pytest.mark.parametrize(("response", "prompt"), [(100_000, 20), (20, 100_000), (100_000, 100_000)])
def test_tiling_of_equal_words(response, prompt):
    import time

    began = time.perf_counter()
    assert pairs.is_copy("word " * response, "word " * prompt)
    assert time.perf_counter() - began < 5


def test_short_copies():
    assert pairs.is_copy("Define a stack", "Define a stack.") and pairs.is_copy("Define a stack.", "Read this. Define a stack. Then stop.")
    assert not pairs.is_copy("a stack", "Define a stack.") and not pairs.is_copy("", "Define a stack.") and not pairs.is_copy("B", "Which one?")


def test_find_defects(spark):
    good = ("Which list holds the nodes that are done?", ["open list", "closed list"], "B", SENTENCES[1], "mcq")
    rows = {
        "ok": good, "none": (*good[:2], None, SENTENCES[1], "mcq"), "opt": (*good[:2], "C", SENTENCES[1], "MCQ "), "opt2": (good[0], ["x", " "], "b)", SENTENCES[1], "mcq"), "opt3": (good[0], None, "A", SENTENCES[1], "mcq"),
        "free": (good[0], None, "the closed list", SENTENCES[1], "cloze"), "no": (good[0], None, "No", SENTENCES[1], "true_false"), "a": (*good[:2], "A", SENTENCES[1], "mcq"), "tbd": (*good[:3], "TBD", "mcq"), "cut": (*good[:3], "A closed list holds the nodes that", "mcq"), "ref": (*good[:3], "I cannot help with that.", "mcq"),
        "cop": (*good[:3], good[0], "mcq"), "lang": (*good[:3], "Die Liste der Knoten ist nicht leer.", "mcq"), "nul": (None, None, None, None, None),
    }
    data = [(k, *v, "z") for k, v in rows.items()] + [("ok", *good, "z"), (None, *good, "z")]
    df = spark.createDataFrame(data, "id string, stem string, options array<string>, answer string, explanation string, qtype string, choice string")
    got = pairs.find_defects(df, "id", "stem", "options", "answer", "explanation", "qtype").collect()
    assert sorted((r["id"], r["defect"]) for r in got) == sorted([("none", "empty"), ("opt", "empty"), ("opt2", "empty"), ("opt3", "empty"), ("tbd", "empty"), ("cut", "truncated"), ("ref", "refusal"), ("cop", "copied"), ("lang", "other_language"), ("nul", "empty")])
    assert pairs.find_defects(df.limit(0), "id", "stem", "options", "answer", "explanation", "qtype").count() == 0


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("He said (as noted above. That was the end of the story.", ["bracket"]), ("<p>A <b>balanced tree if every node. It is so.", ["tag"]), ("**bold", ["strong"]), ("He **is** it, __init__ too, and a**b", []), ("```py\nx=(1", ["fence"]), ("```py\nx=(1\n```\nso", []), ("a) x\nb)", ["item"]), ("1. one\n2. two", []),
        ('It is "so', ["straight"]), ('5" wide', []), ("“open", ["bracket"]), ("„zu“ und “so”", []), ("see `code (", ["code"]), ("see `code (` here", []), (r"\begin{align} x", ["environment"]), ("$$ x", ["formula"]), ("x :( sad", []), ('<a href="x', ["tag"]), ("a < b and c", []), ("- a\n- b (c\n\nnew paragraph.", []), ("f(x[1", ["bracket", "bracket"]), ("", []),
    ],
)
def test_pushdown_parser(text, kinds):
    assert [s.kind for s in nesting.parse(text)] == kinds


@pytest.mark.parametrize("text", ["(" * 100_000, "` " * 50_000, '"' * 100_001, "<b>" * 50_000 + "**" * 30_000, "1. \n" * 30_000, "*" * 100_000, "x" * 1_000_000])
def test_pushdown_parser_takes_any_length(text):
    import time

    began = time.perf_counter()
    nesting.parse(text)
    assert time.perf_counter() - began < 10
