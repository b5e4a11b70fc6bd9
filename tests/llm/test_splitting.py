import random
import re

import pytest

from stemforge.llm import splitting

TOKEN = re.compile(r"\w+|[^\w\s]")


def test_tokens_are_those_of_the_definition():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("ab_1 é語.,\n\t ½🤖") for _ in range(rng.randrange(40)))
        begins, ends, _ = splitting.token_offsets(text)
        assert [text[b:e] for b, e in zip(begins, ends)] == TOKEN.findall(text)


@pytest.mark.parametrize(("limit", "overlap", "least"), [(1, 0, 1), (5, 2, 1), (8, 7, 3), (12, 0, 12), (20, 5, 4)])
def test_round_trip(limit, overlap, least):
    rng = random.Random(limit)
    for _ in range(80):
        text = "".join(rng.choice(["word", " ", " ", ". ", "\n\n", "x", "。", "!", "\n", '."']) for _ in range(rng.randrange(150)))
        tokens = TOKEN.findall(text)
        pieces = splitting.cut(text, limit, overlap, least)
        assert all(n <= limit for _, n, _, _ in pieces) and pieces[0][0] == 0
        assert pieces[-1][0] + pieces[-1][1] == len(tokens)
        for (a, n, _, _), (b, _, _, _) in zip(pieces, pieces[1:]):
            assert b == a + n - overlap and b > a


def test_natural_cuts_are_preferred():
    text = "One two three. Four five six seven. Eight nine ten eleven twelve."
    first = splitting.cut(text, 10, 2)[0]
    assert first[1] == 9 and first[3]
    assert splitting.cut("a b c d e f g h", 4, 1)[0][3] is False


def test_frame(spark):
    long = "word " * 30_000
    rows = [(1, "a b c"), (2, None), (3, ""), (4, " \n"), (5, long), (5, long), (None, "a b c d e f")]
    df = spark.createDataFrame([(k, t, 1, "y") for k, t in rows], "id long, text string, piece int, n_pieces string")
    got = splitting.split_oversized(df, "id", "text", 5, 1).collect()
    pieces = lambda k: [(r["piece_no"], r["n_tokens"], r["piece"]) for r in got if r["id"] == k]
    assert pieces(1) == [(0, 3, "a b c")] and pieces(2) == [(0, 0, None)] and pieces(3) == [(0, 0, "")] and pieces(4) == [(0, 0, " \n")]
    assert pieces(None) == [(0, 5, "a b c d e"), (1, 2, "e f")]
    assert len(pieces(5)) == 2 * 7500 and splitting.split_oversized(df.limit(0), "id", "text", 5, 1).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, "id", "text", 5, 5)
