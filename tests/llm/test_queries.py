"""The queries of this package on the smallest tables: against their SQL, or what must hold of their rows."""

import os
from collections import Counter
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
from oracle_check import digest  # noqa: E402
from stemforge.llm import bpe, catalogue, splitting  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def rows(spark):
    known = {}

    def of(name):
        if name not in known:
            known[name] = catalogue.QUERIES[name](spark, FOLDER).collect()
        return known[name]

    return of


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, name):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = catalogue.QUERIES[name](spark, FOLDER)
    cursor = db.execute(catalogue.ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns) and digest(df.columns, df.collect()) == digest(names, cursor.fetchall())


def test_sample_has_the_quotas(spark, rows):
    drawn = Counter((r["quiz_id"], r["blueprint"], r["dimension"], r["category"]) for r in rows("p1_sample"))
    quotas = {(r["quiz_id"], r["blueprint"], r["dimension"], r["category"]): r for r in rows("p1_joint")}
    assert drawn == Counter({k: r["quota"] for k, r in quotas.items() if r["quota"]})
    needs = {(r["quiz_id"], r["blueprint"], r["dimension"], r["category"]): r for r in rows("p1_report")}
    assert set(needs) == set(quotas) and all(quotas[k]["quota"] <= r["available"] for k, r in needs.items())
    banks = Counter((r["bank_id"], r["id"]) for r in table(spark, "questions").select("bank_id", "id").distinct().collect())
    assert all((needs[r["quiz_id"], r["blueprint"], r["dimension"], r["category"]]["bank_id"], r["id"]) in banks for r in rows("p1_sample"))


def test_pieces_are_under_the_limit(spark, rows):
    most, overlap, _ = (lambda r: (r["max_tokens"], r["overlap_tokens"], 0))(table(spark, "chunk_options").where("option_set = 'default'").first())
    texts = {}
    for r in table(spark, "chunks").select("chunk_id", "text").distinct().collect():
        texts.setdefault(r["chunk_id"], set()).add(r["text"])
    of = {}
    for r in rows("p2_pieces"):
        assert r["n_tokens"] <= most and any(r["piece"] in t for t in texts[r["chunk_id"]])
        of.setdefault(r["chunk_id"], []).append(r)
    assert set(of) == set(texts)
    for key, pieces in of.items():
        if len(texts[key]) == 1:
            pieces.sort(key=lambda r: r["piece_no"])
            ends = [p["first_token"] + p["n_tokens"] for p in pieces]
            assert all(b["first_token"] == end - overlap for b, end in zip(pieces[1:], ends)) and ends[-1] == len(splitting.token_offsets(next(iter(texts[key])))[0])


def test_defects_are_of_known_types(spark, rows):
    ids = {r["id"] for r in table(spark, "questions").select("id").collect()}
    found = rows("p5_found")
    assert len(set(found)) == len(found) and {r["defect"] for r in found} <= {"empty", "truncated", "refusal", "copied", "other_language"} and {r["id"] for r in found} <= ids
    bare = {r["id"] for r in table(spark, "questions").where("answer is null or explanation is null or trim(answer) = ''").collect()}
    assert bare <= {r["id"] for r in found if r["defect"] == "empty"}


def test_ids_decode_to_the_texts(spark, rows):
    import base64

    vocabulary = {int(b): base64.b64decode(a) for a, b in map(bytes.split, (Path(bpe.FOLDER) / "byte_bpe_50k.tiktoken").read_bytes().splitlines())}
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, "documents").collect()}
    got = {r["doc_id"]: b"".join(vocabulary[i] for i in r["ids"]).decode() for r in rows("p6_ids")}
    assert got == texts


def test_every_token_is_packed(spark, rows):
    sizes = {r["doc_id"]: len(r["ids"]) for r in rows("p6_ids")}
    for kind in table(spark, "containers").collect():
        mine = [r for r in rows("p7_packed") if r["container_kind"] == kind["container_kind"]]
        room, items = Counter(), Counter()
        for r in mine:
            room[r["container_id"]] += r["n_tokens"]
            items[r["doc_id"]] += r["n_tokens"]
        assert max(room.values()) <= kind["capacity_tokens"] and set(items) == set(sizes)
        if kind["tokenizer"] == "byte_bpe_50k":
            assert all(items[k] == n for k, n in sizes.items())
        # of few documents a bin may stay half empty, and no more
        assert 1 - sum(room.values()) / (len(room) * kind["capacity_tokens"]) < 0.02 + 1.5 / len(room)


def test_report_counts_what_is_found(spark, rows):
    found = {r["doc_id"] for r in rows("p8_found")}
    texts = {r["doc_id"]: r for r in table(spark, "documents").collect()}
    assert found and found <= {k for k, r in texts.items() if r["text"] and r["text"].strip()}
    report = {r["source"]: r for r in rows("p8_report")}
    assert {s: r["n_cut"] for s, r in report.items() if r["n_cut"]} == Counter(texts[k]["source"] for k in found)
    assert {s: r["n_texts"] for s, r in report.items()} == Counter(r["source"] for r in texts.values())
