import json

import pytest
from pyspark.sql import functions as F

from stemforge import __main__ as command_line
from stemforge import pipeline, session
from stemforge.config import Settings, load_config
from stemforge.operators import assembly, generation
from stemforge.operators.chunking import ChunkOptions
from stemforge.sources.readers import ingest
from stemforge.streaming import incremental

BOOK = "# Chapter 1: Search\n## 1.1 Trees\n" + "A tree has nodes. " * 60 + "\n\n" + "A leaf has none. " * 60 + "\n## 1.2 Empty\n\n# Chapter 2: Logic\nA rule holds. " * 1
ITEM = {"qtype": "cloze", "bloom_level": "apply", "difficulty": "easy", "stem": "A tree has ____.", "answer": "nodes", "explanation": "The tree has nodes as it says."}


@pytest.fixture
def book(tmp_path):
    path = tmp_path / "book.md"
    path.write_text(BOOK)
    return str(path)


def test_ingest(spark, book, tmp_path):
    config = tmp_path / "c.yaml"
    config.write_text("chunking: {target_tokens: 200, max_tokens: 250, min_tokens: 5, overlap_tokens: 20, other: 1}\n")
    chunks = ingest(spark, book, None, load_config(str(config))).collect()
    assert {c["chapter_num"] for c in chunks} == {1} and all(0 < c["token_count"] <= 250 for c in chunks) and len({c["chunk_id"] for c in chunks}) == len(chunks)
    assert all(c["section_label"] == "1.1" and c["chunk_id"].startswith("ch1_s1.1_chunk_") for c in chunks)
    assert ingest(spark, book, [2]).count() == 0 and ingest(spark, book, []).count() == len(ingest(spark, book).collect())
    (tmp_path / "plain.txt").write_text("nothing here")
    for bad in (str(tmp_path / "plain.txt"), "x.doc"):
        with pytest.raises(ValueError):
            ingest(spark, bad)


def test_settings(monkeypatch, tmp_path, caplog):
    monkeypatch.setenv("STEMFORGE_PER_CHUNK", "3")
    monkeypatch.setenv("STEMFORGE_OTHER", "x")
    assert Settings.from_environment().per_chunk == 3
    (tmp_path / "empty.yaml").write_text("")
    assert load_config(str(tmp_path / "empty.yaml")) == load_config(None)
    assert load_config("none.yaml") == load_config(None) and "none.yaml" in caplog.text
    (tmp_path / ".env").write_text("# a comment\nSTEMFORGE_MODEL = \"m1\"\nexport STEMFORGE_PER_CHUNK=9\nOTHER=1\nnothing\n")
    held = Settings.from_environment(file=str(tmp_path / ".env"))
    assert (held.model, held.per_chunk) == ("m1", 3)


def test_quiz_from_chunks(spark, book):
    chunks = ingest(spark, book)
    questions, replies = pipeline.questions_from_chunks(chunks, 1, lambda m, j: json.dumps([ITEM, ITEM | {"answer": ""}]))
    rows = questions.collect()
    assert len(rows) == chunks.count() == replies.count() and rows[0]["source_ref"] == "ch1_s1.1_chunk_001" and rows[0]["section"] == "1.1" and len(rows[0]["id"]) == 12
    quiz = pipeline.quiz_of(questions, "T", assembly.blueprint(None, 1, F.lit(2), "single-chunk"), 50, ["chapter_num", "seq", "pos"]).first()
    held = json.loads(quiz["quiz"])
    assert held["title"] == "T" and len(held["questions"]) == quiz["n_questions"] and held["blueprint"]["rag_top_k"] is None and held["created_at"].endswith("Z")


def test_command_line_keeps_all_questions(spark, book, tmp_path, monkeypatch):
    n = 10_003
    asked = {f: F.lit(v) for f, v in ITEM.items()} | {"id": F.col("id").cast("string"), "chapter": F.lit(1), "section": F.lit(None).cast("string"), "options": F.lit(None).cast("array<string>"), "source_ref": F.lit("c"), "chapter_num": F.lit(1), "seq": F.col("id"), "pos": F.lit(0)}
    monkeypatch.setattr(pipeline, "questions_from_chunks", lambda *a: (spark.range(n).select(*[v.alias(k) for k, v in asked.items()]), None))
    monkeypatch.setattr(command_line, "local_session", lambda: spark)
    assert command_line.main([book, "--output", str(tmp_path / "quiz.json")]) == 0
    held = json.loads((tmp_path / "quiz.json").read_text())["questions"]
    assert [q["id"] for q in held] == [str(i) for i in range(n)]


def test_quiz_from_passages(spark):
    hits = spark.createDataFrame([(1, "1.1", 1, "c1", "The tree has nodes as it says"), (2, None, 1, "c2", "other words")], "chapter_num int, section_label string, rank_no int, chunk_id string, text string")
    questions, _ = pipeline.questions_from_passages(hits, 1, 5, lambda m, j: json.dumps({"questions": [ITEM]}))
    got = {r["source_ref"]: r["is_grounded"] for r in questions.collect()}
    assert got == {"c1": True, "c2": False}


def test_retrieval_of_targets(spark):
    rows = [("a", 1, "1.1", "tree", [1.0, 0.0]), ("b", 1, "1.1", "leaf", [0.0, 1.0]), ("c", 1, None, "lead", [1.0, 0.0]), ("d", 2, "2.1", "rule", [1.0, 1.0])]
    index = spark.createDataFrame(rows, "chunk_id string, chapter_num int, section_label string, text string, embedding array<double>")
    targets = spark.createDataFrame([(1, "1.1"), (1, None), (9, "9.9")], "chapter_num int, section_label string")
    got = pipeline.retrieve(index, targets, lambda texts: [[0.0, 1.0]] * len(texts), 5).collect()
    assert sorted((r["chapter_num"], r["section_label"] or "", r["rank_no"], r["chunk_id"], r["distance"]) for r in got) == [(1, "", 1, "c", 2.0), (1, "1.1", 1, "b", 0.0), (1, "1.1", 2, "a", 2.0)]
    chunks = targets.withColumn("chunk_id", F.lit("x"))
    questions, replies = pipeline.generate_questions(chunks, 1, lambda m, j: json.dumps([ITEM]), use_passages=True, index=index, model=lambda texts: [[0.0, 1.0]] * len(texts))
    assert sorted(r["source_ref"] for r in questions.collect()) == ["b", "c"]
    assert sorted(r["status"] for r in replies.collect()) == ["no passages", "ok", "ok"]
    counts = generation.run_counters(replies, questions).first()
    assert (counts["n_prompts"], counts["n_answered"], counts["n_failed"], counts["n_questions"], counts["n_not_grounded"]) == (3, 2, 1, 2, 2)
    for missing in ({"index": index}, {"model": len}, {}):
        with pytest.raises(ValueError):
            pipeline.generate_questions(chunks, 1, lambda m, j: "", use_passages=True, **missing)


def test_command_line_with_passages(spark, book, tmp_path, monkeypatch):
    monkeypatch.setattr(command_line, "local_session", lambda: spark)
    monkeypatch.setattr(command_line, "release", lambda s: True)
    monkeypatch.setattr(command_line.chat, "transport", lambda s: lambda m, j: json.dumps({"questions": [ITEM]}))
    out, index = str(tmp_path / "out" / "quiz.json"), str(tmp_path / "index")
    for _ in range(2):  # the second run keeps the index
        assert command_line.main([book, "--rag", "--rag-top-k", "2", "--index-dir", index, "--output", out, "--show", "1", "-v", "--chapters", "1", "--config", str(tmp_path / "none.yaml")]) == 0
    held = json.loads((tmp_path / "out" / "quiz.json").read_text())
    assert held["title"] == "Quiz — Chapters 1" and held["blueprint"] == {"chapters": [1], "per_chunk": 2, "total_chunks": spark.read.parquet(index).count(), "generation_mode": "RAG", "rag_top_k": 2, "grounding_check": True}
    assert [q["source_ref"] for q in held["questions"]] == ["ch1_s1.1_chunk_001"]
    assert command_line.main([book, "--rag", "--no-rag", "--output", out]) == 0
    assert json.loads((tmp_path / "out" / "quiz.json").read_text())["blueprint"]["generation_mode"] == "single-chunk"
    assert command_line.main([book, "--ingest-only", "--export-schemas", str(tmp_path / "schemas")]) == 0 and (tmp_path / "schemas" / "quiz.schema.json").exists()


def test_many_pdf_books(spark, tmp_path):
    books = {"a.pdf": ([(1, "1 Search", 1), (2, "1.1 Trees", 1), (2, "1.2 Leaves", 2)], ["A tree has nodes. " * 30, "A leaf has none. " * 30]), "b.pdf": ([(1, "1 Logic", 1), (1, " 2 Rules", 3)], ["A rule holds. " * 30, "", "A fact is true. " * 30])}
    for name in books:
        (tmp_path / name).write_bytes(name.encode())
    got = ingest(spark, f"{tmp_path}/*.pdf", [1, 2], opener=lambda content: books[content.decode()]).collect()
    seen = {(r["book"].rsplit("/", 1)[-1], r["chapter_num"], r["section_label"], r["page_start"], r["page_end"], r["text"].split(".")[0]) for r in got}
    assert seen == {("a.pdf", 1, "1.1", 1, 1, "A tree has nodes"), ("a.pdf", 1, "1.2", 2, 2, "A leaf has none"), ("b.pdf", 1, "1.0", 1, 2, "A rule holds"), ("b.pdf", 2, "2.0", 3, 3, "A fact is true")}
    for numbers in ([], [9]):
        with pytest.raises(ValueError):
            ingest(spark, f"{tmp_path}/*.pdf", numbers, opener=lambda content: books[content.decode()])
    with pytest.raises(ValueError):
        ingest(spark, f"{tmp_path}/a.pdf", opener=lambda content: ([], ["text"]))


def test_chat(monkeypatch):
    sent = []
    monkeypatch.setattr(command_line.chat, "_post", lambda settings, path, body: sent.append((path, body)) or {"choices": [{"message": {"content": None}}], "data": [{"index": i, "embedding": [float(i)]} for i in reversed(range(len(body.get("input", []))))]})
    settings = Settings(model="m", embedding_model="e")
    assert command_line.chat.chat(settings, []) == "" and command_line.chat.chat(settings, [], True, 0.1, 7, seed=3) == ""
    assert (sent[0][1]["temperature"], sent[0][1]["max_tokens"]) == (0.7, 2048) and "response_format" not in sent[0][1]
    assert (sent[1][1]["temperature"], sent[1][1]["max_tokens"], sent[1][1]["seed"]) == (0.1, 7, 3) and sent[1][1]["response_format"] == {"type": "json_object"}
    assert command_line.chat.embedder(settings)(["x"] * 65)[:2] == [[0.0], [1.0]] and [len(b["input"]) for p, b in sent if p == "/embeddings"] == [64, 1]


def test_a_cluster_must_name_the_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda *a: None)
    other = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(ValueError):
        session.shared_folder(other)
    kept = session.written(spark.range(3), "x")
    assert kept.count() == 3 and session.run_folder(spark) in kept.inputFiles()[0]


def test_structured_replies():
    assert generation.ask_structured(lambda m, j: "```\n[1]\n```", [], lambda p: isinstance(p, list)) == [1]
    with pytest.raises(ValueError):
        generation.ask_structured(lambda m, j: "{}", [], lambda p: isinstance(p, list))


def test_stream_goes_on_and_drops_repeats(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "doc_id long, text string, received_at timestamp"
    day = lambda ids: spark.createDataFrame([(i, "A tree has nodes. " * 40, None) for i in ids], schema).withColumn("received_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")))
    for ids in ([1, 2, 2], [2, 3]):
        day(ids).write.mode("append").parquet(folder)
        stream = incremental.chunk_stream(incremental.arriving(spark, folder, day([1])), "doc_id", "text", "received_at", options=ChunkOptions(100, 120, 10, 10))
        incremental.write_chunks(stream, out, state).awaitTermination(120)
    got = spark.read.parquet(out)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == {1, 2, 3} and got.groupBy("doc_id", "pos").count().where("count > 1").count() == 0
