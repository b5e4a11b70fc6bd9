"""Defects of responses: empty, truncated, refusal, copied, in another language.

Truncation is parsed for (fences, brackets, quotations, list items, markup: a pushdown parser over the
whole response) and then judged by the last words; copies are found by greedy string tiling; languages
by script and function words; refusals by a grammar that every sentence is parsed with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemforge.llm import endings
from stemforge.llm.languages import differs
from stemforge.llm.nesting import parse
from stemforge.llm.refusals import is_refusal
from stemforge.llm.tiling import tiles
from stemforge.session import written

#: Stand-ins for a missing value.
STAND_INS = frozenset("n/a na n.a. n.a none null nil nan tbd tba todo unknown undefined missing empty blank (none) (empty) (blank) <null> <none> placeholder xxx fixme".split()) | {"not available", "not applicable", "no answer", "no explanation", "to be determined", "to be done", "to do", "lorem ipsum"}
#: Shortest tile in words, and the shares of the response and of a sentence of the prompt that tiles must cover.
TILE, RESPONSE_SHARE, SENTENCE_SHARE = 3, 0.85, 0.8
#: Words of a sentence that is still a copy with small changes, and letters of a word that may be an abbreviation.
LEAST_CHANGED, LEAST_FRAGMENT = 5, 3
#: Questions that the numbers of :mod:`stemforge.llm.endings` are stated for here.
PER_TEXTS = 12_000
#: Share of cut texts among the responses that are no phrase and do not end as a sentence, before they are looked at.
PRIOR = 0.8

#: Longest phrase, in words: one that begins with a capital, and any other.
NAME_WORDS, PHRASE_WORDS = 5, 8
#: Words that no phrase ends with.
LEADING_ON = frozenset("the a an and or of to with for from by as than that which who whose because if when while in on at into der die das ein eine und oder von mit zu weil le la les un une et ou de du des el los las y o que".split())

_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_LABELS = re.compile(r"^\s*[\"'“”„«»*_#>\-–—]*\s*(?:(?:the\s+)?(?:answer|response|explanation|solution|question|antwort|erklärung|frage|réponse|explication|respuesta|explicación|答案|答え)\s*[:：])?\s*", re.IGNORECASE)


def has_content(text: str | None) -> bool:
    """Whether a text holds a letter or digit and is no stand-in for a missing value."""
    if text is None:
        return False
    stripped = text.strip()
    if len(stripped) <= 20:
        bare = stripped.lower()
        if bare in STAND_INS or bare.strip("[](){}<>.!?*_-\"' ") in STAND_INS:
            return False
    return any(map(str.isalnum, stripped))


def names_missing_option(answer: str, options: list[str | None] | None) -> bool:
    """Whether an answer that is an option's letter names none, or one that holds nothing."""
    m = re.fullmatch(r"\s*[(\[]?\s*([A-Za-z])\s*[)\].:]?\s*", answer)
    if not m:
        return False
    at = ord(m.group(1).upper()) - 65
    return options is None or at >= len(options) or not has_content(options[at])


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@lru_cache(maxsize=16)
def _prompt_words(prompt: str) -> tuple[list[str], frozenset[str]]:
    """Words of a prompt, which its answer and explanation are both held against."""
    held = words(prompt)
    return held, frozenset(held)


def is_copy(response: str, prompt: str) -> bool:
    """Whether a response gives back the prompt, or a whole sentence of it, and adds nothing.

    The same words as the prompt or one of its sentences are a copy at any length. With changes, tiles must
    cover most of the response and of one sentence of the prompt, which then has five words at least; a
    prompt may be given back several times over.
    """
    mine, (theirs, known) = words(_LABELS.sub("", response, count=1)), _prompt_words(prompt)
    if not mine or not theirs:
        return False
    if sum(w in known for w in mine) < RESPONSE_SHARE * len(mine):
        return False
    sentences = [words(s) for s in _SENTENCE.split(prompt)]
    if mine == theirs or mine in sentences:
        return True
    if min(len(mine), len(theirs)) < LEAST_CHANGED:
        return False
    if sum(t[2] for t in tiles(mine, theirs, TILE)) < RESPONSE_SHARE * len(mine):
        return False
    hit = [False] * len(theirs)
    for at, _, n in tiles(theirs, mine, TILE):
        hit[at : at + n] = [True] * n
    at = 0
    for sentence in sentences:
        n = len(sentence)
        if n >= LEAST_CHANGED and sum(hit[at : at + n]) >= SENTENCE_SHARE * n:
            return True
        at += n
    return False


@dataclass
class Ending:
    """Whether a response breaks off; where the counts decide (``cut`` None), by ``asked``: the chance is under ``limit`` times the usual one, or, without a limit, the last word is broken."""

    cut: bool | None
    asked: endings.Question | None = None
    limit: float | None = None


def truncation(text: str, answer: bool) -> Ending:
    """How a response ends.

    An answer that is a phrase (a few words that begin like no sentence) is whole, unless it ends within
    a word, at a mark, at a word that leads on, or with something left open. One word of up to three
    letters, as an option's letter or an abbreviation, is whole.
    """
    bare = text.strip()
    if answer and endings.n_words(bare) <= 1 and sum(map(str.isalnum, bare)) <= LEAST_FRAGMENT and not endings.MARK.search(bare):
        return Ending(False)
    phrase = endings.n_words(bare) <= (NAME_WORDS if bare[:1].isupper() else PHRASE_WORDS)
    if answer and phrase and not endings.MARK.search(bare) and not parse(bare):
        last = endings.tokens(bare)[-1:]
        if last and last[0] in LEADING_ON:
            return Ending(True)
        if not last or not last[0].isalpha() or last[0] == "N" or not last[0].isascii():
            return Ending(False)
        return Ending(None, endings.Question(endings.contexts(last, 1), None, last[0]))
    seen = endings.Reading(text)
    found = seen.verdict(PRIOR, short_is_title=False)
    return Ending(found.cut) if found.cut is not None else Ending(None, seen.question, found.limit)


def is_truncated(text: str, model: endings.Endings, answer: bool) -> bool:
    """Whether a response breaks off, by the counts of ``model``."""
    end = truncation(text, answer)
    if end.cut is not None:
        return end.cut
    if end.limit is None:
        return not model.knows(end.asked.word) and model.begins_longer(end.asked.word)
    return model.answer(end.asked) < end.limit * model.usual


def defects(stem: str | None, options: list[str | None] | None, answer: str | None, explanation: str | None, choice: bool) -> tuple[list[str], list[Ending]]:
    """Types of defect, each once, of one response to a stem with its options; and ends of it that may make it truncated, if the counts say so."""
    out: set[str] = set()
    left: list[Ending] = []
    if choice and answer is not None and names_missing_option(answer, options):
        out.add("empty")
    prompt = stem or ""
    for text, is_answer in ((answer, True), (explanation, False)):
        if not has_content(text):
            out.add("empty")
            continue
        if is_refusal(text):
            out.add("refusal")
        elif is_copy(text, prompt):
            out.add("copied")
        elif (end := truncation(text, is_answer)).cut:
            out.add("truncated")
        elif end.cut is None:
            left.append(end)
        if differs(text, prompt):
            out.add("other_language")
    return sorted(out), [] if "truncated" in out else left


def find_defects(pairs: DataFrame, key: str, stem: str, options: str, answer: str, explanation: str, kind: str, choice: str = "mcq") -> DataFrame:
    """``key`` and ``defect``, one row per key and type.

    ``choice`` is the value of ``kind`` (trimmed, in any case) whose answers are letters of options. Null
    keys are left out, repeated rows and equal findings count once, a null stem has no language and
    nothing to copy. Whole texts are read, of all rows; the counts are those of all rows too. Empty tables
    give no rows; other columns are not read.
    """
    names = {"key": key, "stem": stem, "options": options, "answer": answer, "explanation": explanation}
    rows = pairs.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()], (F.lower(F.trim(F.col(f"`{kind}`"))) == choice).alias("choice")).where("key is not null")
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *T._parse_datatype_string(f"defect string, limit double, {endings.ASKED}").fields])
    rest = list(zip(schema.names[1:], (pa.string(), pa.float64(), *endings.ASKED_ARROW)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(1, 6)]
            at, found = [], []
            for i, (s, o, a, e, c) in enumerate(zip(*columns)):
                settled, left = defects(s, o, a, e, bool(c))
                found += [(d, None, *endings.asked_fields(None)) for d in settled]
                found += [("truncated", end.limit, *endings.asked_fields(end.asked)) for end in left]
                at += [i] * (len(settled) + len(left))
            fields = zip(*found) if found else [()] * len(rest)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(f, t) for f, (_, t) in zip(fields, rest))], names=schema.names)

    seen = written(rows.mapInArrow(judge, schema), "defects")
    chances, usual = endings.chances(seen, rows, F.concat_ws("\n", "stem", "answer", "explanation"), PER_TEXTS)
    open_ends = seen.where("question is not null").select("key", "defect", "limit", "question").join(chances.hint("shuffle_hash"), "question")
    told = open_ends.where(F.when(F.col("limit").isNull(), F.col("broken")).otherwise(F.col("chance") < F.col("limit") * usual))
    return seen.where("question is null").select("key", "defect").unionByName(told.select("key", "defect")).distinct().withColumnRenamed("key", key)
