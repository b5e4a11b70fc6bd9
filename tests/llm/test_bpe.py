import random

import pytest
from pyspark.sql import functions as F

from stemforge.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.vocabulary_path("byte_bpe_50k")
TEXTS = ["", "Hello world's \n\n  end ", "a" * 5000, "ab" * 900 + "!", "日本語テキスト" * 50, "naïve ½ ① x", "<|endoftext|>", "\r\n\t x", " " * 99, "they'll I'D we've", "🤖👩‍🏫 ok", "zero​width nbsp", "aaaa aaab aaa", "0" * 300]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_same_ids_as_the_library(reference):
    rng = random.Random(2)
    letters = "aab bé' \n語1_-.s"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    assert bpe.encode_column(texts, PATH).to_pylist() == reference(texts)


def test_memory_is_bounded_and_ids_stay(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 5)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 10)
    encoder = bpe.Encoder(PATH)
    texts = ["one two three four five six seven", "eight nine", "one eight ten", None]
    got = [[i for p in pieces for i in p] for t in texts for pieces in encoder([t])]
    assert got == reference([t or "" for t in texts])


def test_rank_queue_pops_in_order():
    import numpy as np

    queue, ranks = bpe.RankQueue(300_000), [5, 299_999, 64, 63, 4096, 0, 70_000]
    for r in ranks:
        queue.push(r, np.array([r]))
    queue.push(64, np.array([1, 64]))
    out = []
    while (entry := queue.pop()) is not None:
        out.append(entry[0])
        assert entry[1].tolist() == ([1, 64] if entry[0] == 64 else [entry[0]])
    assert out == sorted(ranks)


def test_corpus(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, None), (3, "again", None), (3, "again", None)]
    df = spark.createDataFrame(rows, "id long, text string, ids string")
    got = bpe.encode_corpus(df, "id", "text")
    assert got.columns == ["id", "ids"]
    want = sorted((str(r[0]), ids) for r, ids in zip(rows, reference([r[1] or "" for r in rows])))
    assert sorted((str(r["id"]), list(r["ids"])) for r in got.collect()) == want
    assert bpe.encode_corpus(df.limit(0), "id", "text").count() == 0
    lengths = df.where("id is not null").select("id", bpe.token_lengths(F.col("text")).alias("n")).collect()
    assert sorted((r["id"], r["n"]) for r in lengths) == sorted((r[0], len(i)) for r, i in zip(rows, reference([r[1] or "" for r in rows])) if r[0] is not None)
