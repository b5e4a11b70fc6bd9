import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemforge.functions import text as T
from stemforge.operators import assembly, chunking, generation, grounding, prompts, report, responses, retrieval, structure

TOC = [(0, 1, " Preface ", 1), (1, 1, "1 Search", 3), (2, 2, "1.1 Trees", 3), (3, 2, "1.2 Graphs", 3), (4, 1, "2 Logic", 9), (5, 3, "3 Learning\n", 12), (6, 2, "3.1.2 Nets", 14), (7, 1, None, 20), (8, 1, "1.x odd", 21)]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_text_expressions(spark):
    assert one(spark, "  \na b\t", T.strip) == "a b"
    assert one(spark, "ab_1 c-d é!", T.token_count) == 6
    assert one(spark, None, T.token_count) == 0
    assert one(spark, "a\n \nb\n\n\n c \n\n", T.split_paragraphs) == ["a", "b", "c"]
    assert one(spark, None, T.split_paragraphs) == []
    assert one(spark, "One. Two!  Three", T.split_sentences) == ["One.", "Two!", "Three"]
    assert one(spark, "B a_b A", T.word_set) == ["a", "b"]


def test_structure(spark):
    toc = spark.createDataFrame(TOC, "ord int, level int, title string, page int")
    chapters = [(r["number"], r["title"], r["page_start"], r["page_end"]) for r in structure.chapters(toc, 30).orderBy("ord").collect()]
    assert chapters == [(1, "Search", 3, 8), (2, "Logic", 9, 11), (3, "Learning", 12, 30)]
    got = {r["label"]: (r["page_start"], r["page_end"]) for r in structure.sections(toc, 30).collect()}
    # two sections on one page: the first is empty; a chapter without sections has one; the last ends with its chapter
    assert got == {"1.1": (3, 2), "1.2": (3, 8), "2.0": (9, 11), "3.1.2": (14, 30)}
    pages = spark.createDataFrame([(0, p, f"p{p} ") for p in range(1, 16)], "book int, page_no int, text string")
    text = {r["label"]: (r["text"], r["is_empty"]) for r in structure.section_texts(structure.sections(toc, 30).withColumn("book", F.lit(0)), pages, 15).collect()}
    assert text["1.1"] == ("", True) and text["2.0"] == ("p9 \np10 \np11", False) and text["3.1.2"] == ("p14 \np15", False)


def test_books_keep_their_own_contents(spark):
    toc = spark.createDataFrame([("a", *e, 30) for e in TOC] + [("b", 0, 1, "1 Games", 1, 4), ("b", 1, 2, "1.1 Rules", 2, 4), ("b", 2, 1, "2 Ends", 4, 4)], "book string, ord int, level int, title string, page int, n int")
    found = structure.sections(toc, F.col("n"), ["book"])
    got = {(r["book"], r["label"]): (r["title"], r["page_start"], r["page_end"]) for r in found.collect()}
    assert {k: v for k, v in got.items() if k[0] == "b"} == {("b", "1.1"): ("Rules", 2, 3), ("b", "2.0"): ("Ends", 4, 4)}
    assert {k[1]: v[1:] for k, v in got.items() if k[0] == "a"} == {"1.1": (3, 2), "1.2": (3, 8), "2.0": (9, 11), "3.1.2": (14, 30)}
    pages = spark.createDataFrame([(b, p, f"{b}{p}") for b, n in (("a", 15), ("b", 4)) for p in range(1, n + 1)], "book string, page_no int, text string")
    text = {(r["book"], r["label"]): r["text"] for r in structure.section_texts(found.withColumn("n", F.when(F.col("book") == "a", 15).otherwise(4)), pages, F.col("n")).collect()}
    assert text[("a", "3.1.2")] == "a14\na15" and text[("b", "1.1")] == "b2\nb3" and text[("b", "2.0")] == "b4" and text[("a", "1.1")] == "" and len(text) == 6
    assert structure.section_texts(found.limit(0).withColumn("n", F.lit(1)), pages, F.col("n")).count() == 0
    plan = structure.section_texts(found, pages, 15)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_heading_slices(spark):
    md = "intro\n# Chapter 1: Search\nlead\n## 1.1 Trees\nbody a\n## 1.2 Graphs\nbody b\n# Chapter 2 Logic\nonly text\n"
    df = spark.createDataFrame([(1, md), (2, "no headings"), (3, None)], "doc int, text string")
    got = [(r["number"], r["label"], r["title"], r["text"]) for r in structure.heading_slices(df, "doc", "text").orderBy("chapter_pos", "sec_pos").collect()]
    assert got == [(1, "1.1", "Trees", "body a"), (1, "1.2", "Graphs", "body b"), (2, "2.0", "Logic", "only text")]
    assert structure.heading_slices(df, "doc", "text", numbers=[2]).count() == 1
    assert structure.heading_slices(df, "doc", "text", numbers=[]).count() == 3


def test_chapter_lists(spark):
    for spec, want in {"1-3": [1, 2, 3], "1,2,5": [1, 2, 5], "1-3, 2": [1, 2, 3], "3-1": []}.items():
        assert one(spark, spec, structure.chapter_numbers) == want
    assert one(spark, "x", structure.chapter_numbers) is None
    df = spark.createDataFrame([(1,), (2,)], "n int")
    assert [structure.keep_chapters(df, "n", k, e).count() for k, e in ((None, False), ([], True), ([], False), ([2], True))] == [2, 2, 0, 1]


def brute_chunks(paragraphs, target, maximum, minimum, overlap):
    """Written from the rules alone, on texts."""
    count = lambda s: len(re.findall(r"\w+|[^\w\s]", s))

    def keep(parts):
        out, n = [], 0
        for p in parts[::-1]:
            if n + count(p) > overlap:
                break
            out.insert(0, p)
            n += count(p)
        return out

    out, cur = [], []
    for p in paragraphs:
        n = sum(map(count, cur))
        if count(p) > maximum:
            if cur:
                out.append("\n\n".join(cur))
                cur = keep(cur)
            run = []
            for s in re.split(r"(?<=[.!?])\s+", p):
                if run and sum(map(count, run)) + count(s) > target:
                    out.append(" ".join(run))
                    run = []
                run.append(s)
            if run:
                out.append(" ".join(run))
            continue
        if cur and n + count(p) > target:
            if n >= minimum:
                out.append("\n\n".join(cur))
            cur = keep(cur)
        cur.append(p)
    if cur and sum(map(count, cur)) >= minimum:
        out.append("\n\n".join(cur))
    return out


@pytest.mark.parametrize("options", [(12, 20, 4, 5), (12, 20, 0, 0), (6, 8, 3, 30)])
def test_chunks_against_brute_force(spark, options):
    rng = random.Random(1)
    sentence = lambda: " ".join(rng.choice(["alpha", "beta", "x", "naïve"]) for _ in range(rng.randrange(1, 9))) + rng.choice([".", "!", "?"])
    texts = [[" ".join(sentence() for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 9))] for _ in range(60)]
    df = spark.createDataFrame([(i, "\n\n".join(t)) for i, t in enumerate(texts)] + [(99, None), (98, " \n ")], "i int, text string")
    target, maximum, minimum, overlap = options
    got = {}
    for r in chunking.chunk_texts(df, "text", chunking.ChunkOptions(target, maximum, minimum, overlap)).orderBy("i", "pos").collect():
        got.setdefault(r["i"], []).append(r["chunk_text"])
        assert r["token_count"] == len(re.findall(r"\w+|[^\w\s]", r["chunk_text"]))
    assert got == {i: c for i, t in enumerate(texts) if (c := brute_chunks(t, *options))}


def test_chunk_ids(spark):
    df = spark.createDataFrame([(2, 0, "2.1", 0), (2, 0, "2.1", 1), (2, 1, "2.2", 0), (3, 0, "3.0", 0)], "n int, s int, label string, pos int")
    got = [r["chunk_id"] for r in chunking.number_chunks(df, "n", ["s"], "label").orderBy("n", "s", "pos").collect()]
    assert got == ["ch2_s2.1_chunk_001", "ch2_s2.1_chunk_002", "ch2_s2.2_chunk_003", "ch3_s3.0_chunk_001"]


@pytest.mark.parametrize("by", [None, "label"])
def test_nearest_is_exact(spark, by, monkeypatch):
    monkeypatch.setattr(retrieval, "GROUP_ROWS", 20)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=(120, 4)), 1)
    label = rng.integers(0, 3, 120)
    df = spark.createDataFrame([(i, v[i].tolist(), int(label[i])) for i in range(120)] + [(500, None, 1)], "id long, v array<double>, label int")
    got = {}
    for r in retrieval.nearest(df, df.where("id % 20 = 0"), "id", "v", 4, by).orderBy("query", "rank_no").collect():
        got.setdefault(r["query"], []).append(r["key"])
    for q in range(0, 120, 20):
        near = sorted((float(((v[i] - v[q]) ** 2).sum()), i) for i in range(120) if by is None or label[i] == label[q])
        assert got[q] == [i for _, i in near[:4]]


def test_index_is_kept_unless_rebuilt(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, [1.0]), ("b", 2, [2.0])], "chunk_id string, chapter_num int, v array<double>")
    path = str(tmp_path / "index")
    assert retrieval.index_size(spark, path) == 0
    assert retrieval.build_index(df, path) == 2
    assert retrieval.build_index(df.limit(1), path) == 2
    assert retrieval.build_index(df.limit(1), path, rebuild=True) == 1


def test_embed(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    got = retrieval.embed(df, "t", lambda texts: [[float(len(t))] for t in texts]).collect()
    assert [r["embedding"] for r in got] == [[2.0], [0.0]]


@pytest.mark.parametrize(("raw", "bare"), [("{}", "{}"), ("```json\n{}\n```", "{}"), ("```\n[1]", "[1]"), ("``` {} ```", "{}"), ("```j\na```b```\n", "a```b"), ("  x  ", "x"), ("```", "")])
def test_fences(spark, raw, bare):
    assert one(spark, raw, responses.strip_fences) == bare == generation.bare_reply(raw)


GOOD = {"chapter": 2, "qtype": "mcq", "bloom_level": "apply", "difficulty": "easy", "stem": "Which of these?", "options": ["a", "b"], "answer": "B", "explanation": "Because it is so.", "source_ref": "ch2_s2.1_chunk_001"}


def validated(spark, items, defaults=None, payload=None):
    df = spark.createDataFrame([(1, json.dumps({"questions": items} if payload is None else payload))], "k int, reply string")
    rows = responses.validate_items(responses.parse_replies(df, "reply", ["k"]), ["k"], defaults).orderBy("pos").collect()
    return [r["reject_reasons"] for r in rows], rows


def test_validation_rules(spark):
    cases = [
        (GOOD, []), (GOOD | {"section": None, "options": None, "more": 1}, []), (GOOD | {"bloom_level": "memorize"}, ["bloom_level"]), (GOOD | {"difficulty": "nightmare"}, ["difficulty"]),
        (GOOD | {"qtype": "essay"}, ["qtype"]), (GOOD | {"stem": "Short?"}, ["stem"]), (GOOD | {"answer": ""}, ["answer"]), (GOOD | {"answer": " "}, []), (GOOD | {"answer": 5}, ["answer"]),
        (GOOD | {"explanation": "short"}, ["explanation"]), (GOOD | {"options": [1]}, ["options"]), (GOOD | {"options": "a"}, ["options"]), (GOOD | {"id": None}, ["id"]), ("text", ["item"]), (7, ["item"]),
        ({k: v for k, v in GOOD.items() if k != "source_ref"}, ["source_ref"]), (GOOD | {"section": 3}, ["section"]),
    ]
    cases += [(GOOD | {"chapter": c}, []) for c in (1, "2", " 2 ", 2.0, "2.0", True)] + [(GOOD | {"chapter": c}, ["chapter"]) for c in (0, 2.5, "x", None, False, [1], -1)]
    assert validated(spark, [c for c, _ in cases])[0] == [r for _, r in cases]


def test_defaults_fill_absent_keys_only(spark):
    bare = {k: v for k, v in GOOD.items() if k not in ("source_ref", "chapter")}
    reasons, rows = validated(spark, [bare, GOOD | {"source_ref": None, "chapter": None}], {"source_ref": F.lit("c1"), "chapter": F.lit(4)})
    assert reasons == [[], ["chapter", "source_ref"]] and (rows[0]["source_ref"], rows[0]["chapter"]) == ("c1", 4)


@pytest.mark.parametrize(("reply", "parsed", "n"), [('{"questions": []}', True, 0), ("[{}]", True, 1), ("{}", True, 0), ('{"questions": null}', True, -1), ('"x"', False, -1), ("{", False, -1), ("17.7 Layer", False, -1), (None, False, -1), ("", False, -1)])
def test_payloads(spark, reply, parsed, n):
    row = responses.parse_replies(spark.createDataFrame([(1, reply)], "k int, r string"), "r", ["k"]).first()
    assert (row["is_parsed"], row["n_items"]) == (parsed, n)


def test_generation_retries(spark):
    calls = []

    def transport(messages, json_mode):
        calls.append(json_mode)
        if json_mode:
            raise ValueError
        return json.dumps({"questions": [GOOD]}) if len(calls) > 3 else "bad"

    reply, attempts, status = generation.ask(transport, [], 2, set(), 0.0)
    assert (attempts, status, calls) == (2, "ok", [True, False, True, False]) and "questions" in reply
    assert generation.ask(lambda m, j: "[]", [], 3, set(), 0.0) == (None, 3, "failed")
    chunks = spark.createDataFrame([("c1", 1, None, "t" * 5000), ("c2", 1, "1.1", None)], "chunk_id string, chapter_num int, section_label string, text string")
    asked = prompts.chunk_prompts(chunks, 2)
    user = asked.where("chunk_id = 'c1'").first()["messages"][1]["content"]
    assert "Section: N/A" in user and user.count("t" * 3000) == 1 and "t" * 3001 not in user
    out = generation.generate(asked, "chunk_id", lambda m, j: json.dumps([GOOD]), pause=0.0)
    assert generation.run_counters(out).first().asDict() == {"n_prompts": 2, "n_answered": 2, "n_failed": 0, "n_attempts": 2}


def test_passage_prompts_keep_rank_order(spark):
    hits = spark.createDataFrame([(1, "1.1", 2, "b", "two"), (1, "1.1", 1, "a", "one"), (1, "1.1", 9, "z", "far")], "chapter_num int, section_label string, rank_no int, chunk_id string, text string")
    row = prompts.passage_prompts(hits, 1, 5).first()
    assert row["source_ref"] == "a" and "[Passage 1 — a]\none\n\n[Passage 2 — b]\ntwo" in row["messages"][1]["content"] and "far" not in row["messages"][1]["content"]


def test_grounding(spark):
    contexts = spark.createDataFrame([("c", "The open list holds nodes true"), (None, "x")], "k string, t string")
    answers = spark.createDataFrame([(1, "c", "B"), (2, "c", "True"), (3, "c", "open list of wombats"), (4, "none", "open list"), (5, None, None), (6, "c", "Naïve open")], "id int, ref string, a string")
    got = {r["id"]: (round(r["overlap_ratio"], 3), r["is_grounded"]) for r in grounding.check_grounding(answers, contexts, "id", "ref", "a", "k", "t").collect()}
    assert got == {1: (1.0, True), 2: (1.0, True), 3: (0.667, True), 4: (0.0, False), 5: (1.0, True), 6: (1.0, True)}


def test_reports(spark):
    df = spark.createDataFrame([("easy", 1), ("hard", 1), ("easy", 2), ("odd", 2)], "difficulty string, n int")
    assert [(r[1], r[2]) for r in report.count_domain(df, "difficulty", report.DIFFICULTIES).collect()] == [("easy", 2), ("medium", 0), ("hard", 1)]
    assert [(r[1], r[2]) for r in report.count_domain(df.limit(0), "difficulty", report.DIFFICULTIES).collect()] == [("easy", 0), ("medium", 0), ("hard", 0)]
    assert {(r["dimension"], r["value"]): r["n"] for r in report.summary(df, ["difficulty", "n"]).collect()}[("n", "2")] == 2


def test_assembly_and_files(spark, tmp_path):
    fields = ", ".join(f"{f} {'int' if f == 'chapter' else 'array<string>' if f == 'options' else 'string'}" for f in responses.FIELDS)
    rows = [(f"q{i}", 1, None, "mcq", "apply", "easy", "A stem", ["x", None] if i else None, "A", "Since é.", "c", "bank") for i in range(4)]
    quizzes = assembly.assemble(spark.createDataFrame(rows, fields + ", bank string"), "bank", ["id"], 3)
    assert [q["id"] for q in quizzes.first()["questions"]] == ["q0", "q1", "q2"]
    settings = assembly.blueprint([1, 2], 2, F.lit(5), "RAG", 5, True)
    as_json = quizzes.select(assembly.quiz_json(F.lit("z"), F.lit("T"), F.lit("2025-01-02 03:04:05.000006").cast("timestamp"), settings, F.col("questions")).alias("j"))
    back = as_json.select(assembly.read_quiz(F.col("j")).alias("b")).first()["b"]
    assert back["questions"] == quizzes.first()["questions"] and str(back["created_at"]) == "2025-01-02 03:04:05.000006"
    assembly.write_quiz(as_json, "j", str(tmp_path / "deep" / "quiz.json"))
    assert json.loads((tmp_path / "deep" / "quiz.json").read_text())["blueprint"]["rag_top_k"] == 5
    assert len(assembly.export_schemas(str(tmp_path / "schemas"))) == 2 and assembly.json_schemas()["quiz.schema.json"]["required"] == ["title"]
    assert len(spark.range(1).select(assembly.new_id()).first()[0]) == 12


def test_all_questions_of_a_bank_come_out(spark):
    fields = ", ".join(f"{f} {'int' if f == 'chapter' else 'array<string>' if f == 'options' else 'string'}" for f in responses.FIELDS)
    sizes = {"hot": 407, "even": 40, "one": 1, None: 23}
    rows = [(f"q{i:03}", 1, None, "mcq", "apply", "easy", "A stem", None, "A", "Since.", "c", bank, n - i) for bank, n in sizes.items() for i in range(n)]
    quizzes = assembly.assemble_all(spark.createDataFrame(rows, fields + ", bank string, at int").repartition(9), "bank", ["at", "id"], 20).collect()
    for bank, n in sizes.items():
        own = sorted((r["quiz_no"], r["n_questions"], [q["id"] for q in r["questions"]]) for r in quizzes if r["bank"] == bank)
        assert [q for _, _, ids in own for q in ids] == [f"q{i:03}" for i in reversed(range(n))]
        assert [(no, size) for no, size, _ in own] == [(k + 1, min(20, n - 20 * k)) for k in range(-(-n // 20))]
    assert assembly.assemble_all(spark.createDataFrame([], fields + ", bank string, at int"), "bank", ["at", "id"], 20).count() == 0


def test_both_validators_follow_the_same_rules(spark):
    import json

    good = {"chapter": 2, "section": None, "qtype": "mcq", "bloom_level": "apply", "difficulty": "easy", "stem": "Which list is it?", "options": ["a", "b"], "answer": "A", "explanation": "It is the open list.", "source_ref": "c"}
    changes = [{}, {"id": "x"}, {"id": None}, {"id": 5}, {"section": "2.1"}, {"section": 2}, {"options": None}, {"options": []}, {"options": ["a", 1]}, {"options": "a"}, {"stem": "short"}, {"stem": None}, {"stem": "          "}, {"answer": ""}, {"answer": " "}, {"answer": 5}, {"explanation": "x" * 9}, {"source_ref": ""}, {"source_ref": None}]
    changes += [{"chapter": c} for c in ("2", " 2 ", 2.0, "2.0", "+2", "2.", True, False, 2.5, "2.5", 0, -1, None, "x", "1e0", 1e20, 4e9, "99999999999", [2], {"a": 1})]
    changes += [{f: v} for f in ("qtype", "bloom_level", "difficulty") for v in ("essay", None, "MCQ", 3, ["mcq"])]
    items = [good | c for c in changes] + [{k: v for k, v in good.items() if k != f} for f in good] + ["text", 3, None, [], {}]
    rows = spark.createDataFrame([(i, json.dumps([x])) for i, x in enumerate(items)], "n int, reply string")
    for filled in ((), ("chapter", "section", "source_ref")):
        defaults = {f: F.lit(1) if f == "chapter" else F.lit("d") for f in filled}
        found = responses.validate_items(responses.parse_replies(rows, "reply", ["n"]), ["n"], defaults)
        theirs = {r["n"]: len(r["reject_reasons"]) == 0 for r in found.collect()}
        assert theirs == {i: responses.is_valid(x, filled) for i, x in enumerate(items)}, [x for i, x in enumerate(items) if theirs[i] != responses.is_valid(x, filled)]


def test_published_schemas():
    from stemforge.operators import assembly

    question, quiz = assembly.json_schemas().values()
    assert list(question["properties"]) == list(responses.FIELDS) and question["required"] == ["chapter", "qtype", "bloom_level", "difficulty", "stem", "answer", "explanation", "source_ref"]
    assert question["properties"]["stem"] == {"description": "The question text / prompt shown to the student.", "minLength": 10, "title": "Stem", "type": "string"}
    assert question["properties"]["qtype"] == {"$ref": "#/$defs/QuestionType", "description": "Question format."} and "minLength" not in question["properties"]["source_ref"]
    assert question["properties"]["options"]["anyOf"] == [{"type": "array", "items": {"type": "string"}}, {"type": "null"}] and question["properties"]["options"]["default"] is None
    assert set(quiz["$defs"]) == {"QuestionType", "BloomLevel", "Difficulty", "Question"} and quiz["$defs"]["Question"] | {"$defs": question["$defs"]} == question and quiz["required"] == ["title"]


def test_nearest_streams_the_index_and_broadcasts_the_grid(spark, monkeypatch):
    import random

    rng = random.Random(4)
    rows = [(i, [rng.random(), rng.random()], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>, g int")
    asked = df.where("id % 5 = 0")
    want = {}
    for i, q, _ in rows[::5]:
        want[i] = [r[0] for r in sorted(rows, key=lambda r: (sum((a - b) ** 2 for a, b in zip(r[1], q)), r[0]))[:4]]
    for group, block, once in ((50_000, 20_000, 256), (7, 3, 2)):
        monkeypatch.setattr(retrieval, "GROUP_ROWS", group)
        monkeypatch.setattr(retrieval, "BLOCK_QUERIES", block)
        monkeypatch.setattr(retrieval, "AT_ONCE", once)
        got = {}
        for r in retrieval.nearest(df, asked, "id", "v", 4).orderBy("query", "rank_no").collect():
            got.setdefault(r["query"], []).append(r["key"])
        assert got == want
