"""Whether a text breaks off before its last sentence is complete.

Three kinds of evidence are used. A pushdown parser finds what was opened and never closed anywhere in
the text: fences, brackets, quotations, list items, markup, JSON. A mark (an ellipsis, alone or in brackets) may stand for a lost end. And a
model of endings says how often the last words are followed by the end of a sentence or line: it has
counts of word contexts over all texts, in which names and numbers are classes. The ends are read first;
the contexts they ask about are then counted in every text, so nothing is sampled and no model is held.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemforge.llm.nesting import parse
from stemforge.session import written

#: Words of the longest context, and how often a context must occur to count.
CONTEXT, KEPT_FROM = 4, 2
#: Texts that must end with a line before that line is an ending by itself.
COMMON_LAST_LINE = 5
#: Texts that these two numbers, and the weight of counts against the usual chance, are stated for; counts over more texts are scaled to as many.
PER_TEXTS = 4000
#: A word of this many characters is not asked for. Chances behind a common last line, behind the first part of a known word, and behind another word that is not known.
LONGEST_WORD, ENDING, BROKEN, UNKNOWN = 25, 0.99, 0.001, 0.08
#: Kana and ideographs, which are tokens by themselves.
_WIDE = "぀-ヿ㐀-鿿豈-﫿"
_TOKEN = re.compile(rf"[{_WIDE}]|[^\W\d_{_WIDE}]+(?:['’][^\W\d_{_WIDE}]+)*|\d+(?:[.,]\d+)*|\n|[^\w\s]")
#: What ends a sentence, and what may close behind it.
STOPS = ".!?。！？｡"
_CLOSERS = "\"'”’»)]}」』）*_`"
_TERMINAL = re.compile(rf"[{re.escape(STOPS)}][{re.escape(_CLOSERS)}\s]*$")
#: Signs and pictures after the last word, which say nothing about the sentence.
_PICTURES = re.compile("[\\s←-⯿︎️‍☀-➿\U0001f000-\U0001faff]+$")
#: Marks in place of a lost end.
MARK = re.compile(r"\s*(?:[\[(<{]\s*(?:\.{3,}|…|more|cut|truncated|continued|snip)\s*[\])>}]|…+|(?<!\.)\.{3}|�+)\s*$", re.IGNORECASE)
_WIDE_TOKEN = re.compile(f"[{_WIDE}]")
#: Kana and ideographs that count as one word where the length of a line is judged, and words of the longest title.
WIDE_WORD, TITLE_WORDS = 3, 6
#: Abbreviations that stand before something.
_SHORTENED = re.compile(r"(?<!\w)(?:e\.g|i\.e|cf|Fig|Figs|Sec|Eq|Dr|Prof|Mr|Mrs|Ms|vs|approx|z\. ?B|d\. ?h|u\. ?a|bzw|vgl|Abb|p\. ?ej|Sr|Sra|Mme|M)\.$")
_LEADER, _LED = re.compile(r"[. ]\.{3,}$"), re.compile(r"\.{4,} *\d+ *(?:\n|$)")
#: The option of a question, and the share of cut texts among those that end with one without a stop.
_OPTION, OPTION_PRIOR = re.compile(r"\s*(?:[a-hA-H]\)|\([a-hA-H]\)|[A-H]\.)\s"), 0.05


def tokens(text: str) -> list[str]:
    """Words in lower case, but ``N`` for a capitalised word within a line and ``0`` for a number."""
    out, inside = [], False
    for t in _TOKEN.findall(text):
        if t[0].isdigit():
            t = "0"
        elif t[0].isalpha():
            if inside and t[0].isupper():
                t = "N"
            else:
                t = t.lower()
            inside = True
        elif t == "\n" or t in STOPS:
            inside = False
        out.append(t)
    return out


def n_words(text: str) -> int:
    """Words between blanks; kana and ideographs, which have no blanks between words, count as one for each WIDE_WORD of them."""
    wide = 0 if text.isascii() else len(_WIDE_TOKEN.findall(text))
    if not wide:
        return len(text.split())
    return -(-wide // WIDE_WORD) + sum(any(map(str.isalnum, w)) for w in _WIDE_TOKEN.sub(" ", text).split())


#: Multiplier of the keys of contexts, modulo 2**64, and its inverse; marks of keys of a sentence so far and of a whole last line.
_Q, _MASK = 0x9E3779B97F4A7C15, 2**64 - 1
_Q_INVERSE = pow(_Q, -1, 2**64)
_SO_FAR, _LAST_LINE = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D
#: Characters of texts that are counted at once, different tokens remembered by a task, and bits of the filter for each key asked for.
SLICE_CHARS, KEPT_TOKENS, KEY_BITS = 1_000_000, 500_000, 8
#: Logarithms of the fewest and most bits of the filter; with more keys than that it lets more pass, and decides nothing.
LEAST_BITS, MOST_BITS = 16, 30
_OTHER, _NEWLINE, _STOP, _LETTERS, _NUMBER = range(5)


def _digest(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _key(words: Iterable[str], mark: int = 0) -> int:
    """Key of a run of tokens: a polynomial of their hashes, as :func:`_places` takes it from sums over many texts."""
    key = 0
    for w in words:
        key = (key * _Q + _digest(w)) & _MASK
    return (key ^ mark) - ((key ^ mark) >> 63 << 64)


def contexts(words: list[str], at: int) -> list[int]:
    """Keys of the last one to CONTEXT words before ``at``, shortest first, within the line; then of the whole line so far."""
    start = at
    while start > 0 and words[start - 1] != "\n":
        start -= 1
    keys = [_key(words[at - k : at]) for k in range(1, min(CONTEXT, at - start) + 1)]
    begin = at
    while begin > start and words[begin - 1] not in STOPS:
        begin -= 1
    if at - begin > CONTEXT:
        keys.append(_key(words[begin:at], _SO_FAR))
    return keys


@dataclass
class Question:
    """What the end of a text asks of the counts: its contexts, shortest first, its last line, and a last word that may be broken."""

    keys: list[int]
    line: int | None
    word: str | None

    @cached_property
    def id(self) -> int:
        return _key(map(str, [*self.keys, self.line, self.word]))


def question(text: str) -> Question | None:
    """The question whether a sentence or line ends behind ``text``; None where there is no word before."""
    bare = text.rstrip()
    words = tokens(bare[bare.rfind("\n") + 1 :])
    if not words:
        return None
    last = words[-1]
    asked = last.isalpha() and last != "N" and len(last) < LONGEST_WORD and not _WIDE_TOKEN.match(last)
    return Question(contexts(words, len(words)), _key(words, _LAST_LINE), last if asked else None)


@dataclass
class Endings:
    """Counts of all contexts of a few texts, held in one process: sorted keys, occurrences, occurrences at an end; known words; places and ends."""

    keys: np.ndarray
    seen: np.ndarray
    ended: np.ndarray
    words: list[str]
    places: int = 0
    ends: int = 0

    def count(self, key: int) -> tuple[int, int]:
        i = int(np.searchsorted(self.keys, key))
        if i < len(self.keys) and self.keys[i] == key:
            return int(self.seen[i]), int(self.ended[i])
        return 0, 0

    @cached_property
    def usual(self) -> float:
        """Share of ends among all places."""
        return (self.ends + 1) / (self.places + 2)

    def knows(self, word: str) -> bool:
        i = bisect_left(self.words, word)
        return i < len(self.words) and self.words[i] == word

    def begins_longer(self, word: str) -> bool:
        """Whether a known word begins with ``word``, which is none."""
        i = bisect_left(self.words, word)
        return i < len(self.words) and self.words[i].startswith(word)

    def answer(self, asked: Question) -> float:
        """How likely a sentence or line ends where ``asked`` was asked: longer contexts correct shorter ones."""
        if asked.line is not None and self.count(asked.line)[0] >= COMMON_LAST_LINE:
            return ENDING
        if asked.word is not None and not self.knows(asked.word):
            # a word that is not known: most likely the first part of one that is
            return BROKEN if self.begins_longer(asked.word) else UNKNOWN
        chance = self.usual
        for key in asked.keys:
            seen, ended = self.count(key)
            if seen == 0:
                continue
            chance = (ended + 2.0 * chance) / (seen + 2.0)
        return chance


class _Tokens(dict):
    """Numbers of raw tokens in order of arrival; of each its hash (numbers as ``0``, words in lower case), kind, whether it is capitalised, and the word."""

    def __init__(self):
        super().__init__()
        self.hashes, self.kinds, self.capital, self.words = [], [], [], []
        self._arrays = np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool)

    def __missing__(self, raw: str) -> int:
        word, kind, capital = raw, _OTHER, False
        if raw[0].isdigit():
            word, kind = "0", _NUMBER
        elif raw[0].isalpha():
            word, kind, capital = raw.lower(), _LETTERS, raw[0].isupper()
        elif raw == "\n":
            kind = _NEWLINE
        elif raw in STOPS:
            kind = _STOP
        self[raw] = at = len(self.words)
        self.hashes.append(_digest(word))
        self.kinds.append(kind)
        self.capital.append(capital)
        self.words.append(word)
        return at

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, kinds and capitals; only new ones are turned into numbers."""
        done = len(self._arrays[0])
        self._arrays = tuple(np.concatenate((a, np.array(new[done:], a.dtype))) for a, new in zip(self._arrays, (self.hashes, self.kinds, self.capital)))
        return self._arrays


def _last(where: np.ndarray) -> np.ndarray:
    """At each place the last one up to it where ``where`` holds; -1 before the first."""
    return np.maximum.accumulate(np.where(where, np.arange(len(where)), -1))


#: What a character is for _TOKEN: none of a token, a token by itself, or one of a run of letters or digits; what may stand between two of these.
_NONE, _ALONE, _LETTER, _DIGIT = range(4)
_BETWEEN = ((_LETTER, "'’"), (_DIGIT, ".,"))


_UNSEEN = 255


@cache
def _classes() -> np.ndarray:
    """Of every character, what it is for _TOKEN; filled as characters come."""
    return np.full(0x110000, _UNSEEN, np.uint8)


def _class(c: str) -> int:
    if not _TOKEN.match(c):
        return _NONE
    return _DIGIT if c.isdecimal() else _LETTER if c.isalnum() and not _WIDE_TOKEN.match(c) else _ALONE


def _kinds(code: np.ndarray) -> np.ndarray:
    kind = _classes()[code]
    if _UNSEEN in kind:
        new = np.unique(code[kind == _UNSEEN])
        _classes()[new] = [_class(chr(c)) for c in new.tolist()]
        kind = _classes()[code]
    return kind


class Runs:
    """Keys of any runs of characters of a text: polynomials of the characters modulo 2**64, as differences of sums."""

    def __init__(self, text: str, code: np.ndarray | None = None):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) if code is None else code
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((code + np.uint64(1)) * _powers(_Q_INVERSE, len(code)), dtype=np.uint64)))
            self.rising = _powers(_Q, len(code) + 1)[1:]

    def keys(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of the runs from ``first`` to before ``stop``; a text gives the same key wherever it stands."""
        with np.errstate(over="ignore"):
            return (self.sums[stop] - self.sums[first]) * self.rising[first]


def _numbered(texts: list[str], known: _Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all tokens of the texts in order, and behind how many of them each text ends.

    Finds what _TOKEN finds, over all characters at once; only different tokens become strings.
    """
    whole = "\n".join(texts)
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds(code)
    for run, signs in _BETWEEN:
        # a sign between two letters or digits is part of their run
        at = np.flatnonzero((code == ord(signs[0])) | (code == ord(signs[1])))
        at = at[(at > 0) & (at < len(code) - 1)]
        kind[at[(kind[at - 1] == run) & (kind[at + 1] == run)]] = run
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) + np.arange(len(texts))
    kind[ends[:-1]] = _NONE
    other = np.concatenate(([True], kind[1:] != kind[:-1]))
    alone = kind == _ALONE
    first = np.flatnonzero(alone | (other & (kind != _NONE)))
    # a run ends where the kind changes; a token by itself is one character
    change = np.append(np.flatnonzero(other), len(code))
    stop = np.where(alone[first], first + 1, change[np.cumsum(other)[first]])
    counts = np.searchsorted(first, ends)
    _, some, which = np.unique(Runs(whole, code).keys(first, stop), return_index=True, return_inverse=True)
    number = np.array([known[whole[i:j]] for i, j in zip(first[some].tolist(), stop[some].tolist())], np.int64)
    return number[which], counts


def _counted(texts: list[str], known: _Tokens, asked: np.ndarray | None) -> tuple[list[np.ndarray], list[str | None], int, int]:
    """(keys, occurrences, those at an end, those of a word within a line), the words of these, and all places and ends, of the texts' contexts.

    Keys may come several times. Where a text ends without a stop, it may have been cut: that place counts
    for its whole line only, but for names and numbers, which are classes.
    """
    number, stops = _numbered([t.rstrip() for t in texts], known)
    n = len(number)
    if not n:
        return [np.zeros(0, np.int64)] * 4, [], 0, 0
    own, kinds, capital = known.arrays()
    hashes, kind = own[number], kinds[number]
    final = np.zeros(n, bool)
    final[stops[np.diff(stops, prepend=0) > 0] - 1] = True
    newline, letters = kind == _NEWLINE, kind == _LETTERS
    over = newline | (kind == _STOP)
    first = np.concatenate(([True], final[:-1]))
    line = _last(first | np.concatenate(([False], newline[:-1])))
    begin = _last(first | np.concatenate(([False], over[:-1])))
    name = letters & capital[number] & (np.concatenate(([-1], _last(letters)[:-1])) >= begin)
    hashes[name] = _digest("N")
    ended = final | np.concatenate((over[1:], [False]))
    at = np.flatnonzero(~over & (~final | name | (kind == _NUMBER)))
    # one word: counted by its number, names together
    alone, names = at[~name[at]], at[name[at]]
    places = lambda where: np.bincount(number[where], minlength=len(own))
    seen, at_end = places(alone), places(alone[ended[alone]])
    within = places(alone[~(final | np.concatenate((newline[1:], [False])))[alone] & letters[alone]])
    some = np.flatnonzero(seen)
    words = [known.words[i] if w and known.words[i].isalpha() else None for i, w in zip(some.tolist(), within[some].tolist())]
    none = lambda n: np.zeros(n, np.int64)
    out = [[own[some], seen[some], at_end[some], within[some]], [np.array([_digest("N")], np.uint64), np.array([len(names)]), np.array([ended[names].sum()]), none(1)]]
    total, ends = len(at), int(ended[at].sum())
    held: list[tuple[np.ndarray, np.ndarray]] = []
    # hashes times falling powers, so that any run is a difference of two sums; all modulo 2**64
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_Q_INVERSE, n), dtype=np.uint64)))
        rising = _powers(_Q, n)
        last = np.flatnonzero(~over & final)
        runs = [(last, line[last], _LAST_LINE)]
        for k in range(2, CONTEXT + 1):
            far = at[at + 1 - line[at] >= k]
            runs.append((far, far + 1 - k, 0))
        far = at[at + 1 - begin[at] > CONTEXT]
        runs.append((far, begin[far], _SO_FAR))
        for to, since, mark in runs:
            keys, e = (sums[to + 1] - sums[since]) * rising[to] ^ np.uint64(mark), ended[to]
            total, ends = total + len(to), ends + int(e.sum())
            if asked is not None:
                let = np.flatnonzero(passes(keys, asked))
                keys, e = keys[let], e[let]
            held.append((keys, e))
    keys, e = (np.concatenate(x) for x in zip(*held))
    if len(keys):
        order = np.argsort(keys)
        keys = keys[order]
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        out.append([keys[heads], np.diff(np.append(heads, len(keys))), np.add.reduceat(e[order].astype(np.int64), heads), none(len(heads))])
    columns = [np.concatenate(x) for x in zip(*out)]
    return [columns[0].view(np.int64), *columns[1:]], words + [None] * (len(columns[0]) - len(words)), total, ends


@lru_cache(maxsize=4)
def _powers_to(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers, from 0 on, modulo 2**64."""
    return _powers_to(base, 1 << max(16, n - 1).bit_length())[:n]


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[list[str]]:
    """Texts of the first column, as many at once as have SLICE_CHARS characters together."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.append(text)
            size += len(text)
            if size >= SLICE_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def count_contexts(texts: DataFrame, text: Column, asked: Broadcast | None = None) -> DataFrame:
    """``key``, ``seen``, ``ended``, ``within`` and ``word`` of the contexts of all texts, counted in tasks; the null key has all places, ends and ``texts``.

    ``word`` is set for a word that stands within a line somewhere, ``within`` says how often. Contexts that occur fewer than KEPT_FROM times are
    left out. ``asked`` is a filter of keys (see :func:`key_filter`): of other contexts than words, those that it lets
    through are counted, so what is shuffled goes with the questions and the vocabulary.
    """

    names = ["key", "seen", "ended", "within", "texts", "word"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Tokens()
        for some in slices(batches):
            if len(known) > KEPT_TOKENS:
                known = _Tokens()
            columns, words, *total = _counted(some, known, None if asked is None else asked.value)
            arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.nulls(len(words), pa.int64()), pa.array(words, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *(pa.array([v], pa.int64()) for v in (*total, 0, len(some))), pa.nulls(1, pa.string())], names=names)

    counts = texts.select(text.alias("t")).where(F.length("t") > 0).mapInArrow(count, "key long, seen long, ended long, within long, texts long, word string").groupBy("key")
    return counts.agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"), F.sum("within").alias("within"), F.sum("texts").alias("texts"), F.max("word").alias("word")).where(F.col("key").isNull() | (F.col("seen") >= KEPT_FROM))


def fit(texts: DataFrame, text: Column, key: Column | None = None) -> Endings:
    """Counts over all of a few texts, held by the driver; ``key`` decides nothing. Tables are judged by :func:`chances`."""
    table = count_contexts(texts, text).toArrow().sort_by("key")
    total = table.filter(pc.is_null(table["key"]))
    table = table.filter(pc.is_valid(table["key"]))
    words = sorted(w for w in table["word"].to_pylist() if w is not None)
    return Endings(*(table[c].to_numpy() for c in ("key", "seen", "ended")), words, *(pc.sum(total[c]).as_py() or 0 for c in ("seen", "ended")))


def passes(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys a filter (see :func:`key_filter`) lets through."""
    place = keys >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def key_filter(keys: DataFrame, n: int, key_bits: int = KEY_BITS) -> Broadcast:
    """A bitmap over the first bits of ``n`` keys (column ``key``), made in tasks and handed to all of them."""
    size = min(MOST_BITS, max(LEAST_BITS, (n * key_bits).bit_length()))
    place = F.shiftrightunsigned("key", 64 - size)
    words = keys.select(F.shiftright(place, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63).cast("long")).cast("int")).alias("bit"))
    table = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << size - 6, np.int64)
    bits[table["at"].to_numpy()] = table["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


#: Fields that :func:`asked_fields` gives for a question.
ASKED, ASKED_ARROW = "question long, keys array<long>, line long, word string", (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string())


def asked_fields(asked: Question | None) -> tuple:
    return (asked.id, asked.keys, asked.line, asked.word) if asked else (None, None, None, None)


def chances(asked: DataFrame, texts: DataFrame, text: Column, per_texts: int = PER_TEXTS) -> tuple[DataFrame, float]:
    """``question``, ``chance`` and ``broken`` of all questions (fields ASKED) by the contexts of all ``texts``, and the usual chance.

    ``chance`` is that of :meth:`Endings.answer`; ``broken`` says that the last word is not known and begins one that is.
    Nothing is sampled: the texts are counted where they are read, and counts meet the questions by shuffles. Of more
    texts than ``per_texts``, counts are divided by how many times more they are, so shares decide at any size: else chance
    words and last lines of a large table would pass COMMON_LAST_LINE and KEPT_FROM, and rare contexts outweigh the rest.
    """
    asked = written(asked.where("question is not null").select("question", "keys", "line", "word").dropDuplicates(["question"]), "questions")
    places = asked.select("question", "word", F.posexplode(F.concat("keys", F.coalesce(F.array("line"), F.array()))).alias("at", "key"), F.size("keys").alias("n_keys"))
    places = places.where("key is not null")
    counts = written(count_contexts(texts, text, key_filter(places, places.count())), "contexts")
    total = counts.where("key is null").select("seen", "ended", "texts").first() or (0, 0, 0)
    usual, times = (total[1] + 1) / (total[0] + 2), max(1.0, total[2] / per_texts)
    counts = counts.where("key is not null").select("key", (F.col("seen") / times).alias("seen"), (F.col("ended") / times).alias("ended"), F.when((F.col("seen") >= KEPT_FROM * times) & (F.col("within") >= times), F.col("word")).alias("word"))
    met = places.join(counts.select("key", "seen", "ended", F.col("word").isNotNull().alias("known")).hint("shuffle_hash"), "key")
    folded = met.groupBy("question").agg(F.sort_array(F.collect_list(F.struct("at", "seen", "ended", "known", "n_keys"))).alias("met"))
    words = counts.where("word is not null").select("word")
    open_words = asked.where("word is not null").select("word").distinct()
    begun = open_words.where(F.length("word") < LONGEST_WORD).join(_beginnings(words), "word", "left_semi").unionByName(_begun_long(open_words, words)).withColumn("begins", F.lit(True))
    rows = asked.select("question", "word").join(folded, "question", "left").join(begun, "word", "left")
    common = F.exists("met", lambda x: (x["at"] == x["n_keys"]) & (x["seen"] >= COMMON_LAST_LINE))
    unknown = F.col("word").isNotNull() & ~F.coalesce(F.exists("met", lambda x: (x["at"] == 0) & x["known"]), F.lit(False))
    begins = F.coalesce("begins", F.lit(False))
    inner = F.filter("met", lambda x: x["at"] < x["n_keys"])
    told = F.aggregate(inner, F.lit(float(usual)), lambda c, x: (x["ended"] + 2.0 * c) / (x["seen"] + 2.0))
    chance = F.when(F.coalesce(common, F.lit(False)), ENDING).when(unknown, F.when(begins, BROKEN).otherwise(UNKNOWN)).otherwise(F.coalesce(told, F.lit(usual)))
    return rows.select("question", chance.alias("chance"), (unknown & begins).alias("broken")), usual


def _beginnings(words: DataFrame) -> DataFrame:
    """The shorter beginnings of words, of fewer than LONGEST_WORD letters."""
    long = words.where(F.length("word") > 1)
    return long.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("word") - 1, F.lit(LONGEST_WORD - 1))), lambda i: F.left("word", i))).alias("word")).distinct()


def _begun_long(asked: DataFrame, words: DataFrame) -> DataFrame:
    """Asked words of LONGEST_WORD letters or more that begin a longer one: few, so they meet by their first letters."""
    head = F.left("word", F.lit(LONGEST_WORD)).alias("head")
    longer = words.where(F.length("word") > LONGEST_WORD).select(head, F.col("word").alias("whole"))
    met = asked.where(F.length("word") >= LONGEST_WORD).select("word", head).join(longer, "head")
    return met.where(F.startswith("whole", "word") & (F.col("whole") != F.col("word"))).select("word").distinct()


_JSON_SIGNS = re.compile(r"\\.|[\"{}\[\]]", re.DOTALL)


def json_is_open(text: str) -> bool | None:
    """For a text that begins as a JSON object or array: whether it ends before that is closed; else None."""
    s = text.lstrip()
    if not (s.startswith("{") or s.startswith("[{") or re.match(r"\[\s*[\"{\[\d]", s)):
        return None
    stack: list[str] = []
    quoted = False
    for m in _JSON_SIGNS.finditer(s):
        c = m.group()
        if quoted:
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append(c)
        elif c in "}]":
            if not stack:
                return None
            stack.pop()
            if not stack:
                return False
    return True


@dataclass
class Verdict:
    """``cut`` is None where the counts decide: cut if the chance is under ``limit``, or under ``limit`` times the usual one.

    ``why`` is None then where the chance itself is the evidence.
    """

    cut: bool | None
    why: str | None
    limit: float = 0.0
    of_usual: bool = True


class Reading:
    """What the end of a text shows, and what it asks of the counts; the verdict then depends on how likely a cut was before it was read."""

    def __init__(self, text: str):
        self.settled, self.body = self._settle(text)
        self.line = self.body.rsplit("\n", 1)[-1]

    def _settle(self, text: str) -> tuple[Verdict | None, str]:
        """The verdict where nothing else can change it, and the text without white space and pictures at its end."""
        body = text.rstrip()
        tail = body[-200:]
        bare = _PICTURES.sub("", tail) if not tail.isascii() else tail
        self.pictured = len(bare) < len(tail)
        body = (body[:-200] + bare).rstrip() if self.pictured else body
        if not any(map(str.isalnum, body)):
            return Verdict(False, "nothing"), body
        mark = MARK.search(body, max(0, len(body) - 40))
        if mark:
            before = body[: mark.start()]
            aside = mark.group().strip().startswith(".") and n_words(before.rsplit("\n", 1)[-1]) < 3
            return Verdict(not aside, "aside" if aside else "mark"), body
        opened = json_is_open(body)
        if opened is not None:
            return Verdict(opened, "json"), body
        symbols = parse(body)
        if symbols:
            return Verdict(True, symbols[-1].kind), body
        if body.endswith("```"):
            return Verdict(False, "fence closed"), body
        line = body.rsplit("\n", 1)[-1]
        if _LEADER.search(line) and _LED.search(body):
            return Verdict(True, "leader"), body  # a line of a table of contents without its page
        if _SHORTENED.search(body, max(0, len(body) - 12)):
            return Verdict(True, "abbreviation"), body
        return None, body

    @cached_property
    def question(self) -> Question | None:
        """What the counts are asked for where a verdict is left to them: about the end, or about what stands before a stop or closer there."""
        bare = self.body[:-1] if self._stopped or self.body[-1] in _CLOSERS else self.body
        return question(bare)

    @cached_property
    def _stopped(self) -> bool:
        return _TERMINAL.search(self.body, max(0, len(self.body) - 20)) is not None

    def _asked(self, limit: float, of_usual: bool, why: str | None) -> Verdict:
        # where no word stands before, an end is certain
        return Verdict(False, why or "1.000") if self.question is None else Verdict(None, why, limit, of_usual)

    def verdict(self, prior: float, short_is_title: bool = True) -> Verdict:
        """``prior`` is the share of cut texts among those that do not end as a sentence, before the text itself is looked at."""
        if self.settled is not None:
            return self.settled
        body = self.body
        if self._stopped:
            halved = prior > 0.8 and body[-1] == "." and body[-2:-1].isdigit()
            return self._asked(0.5, True, "number") if halved else Verdict(False, "sentence")
        if self.pictured:
            return Verdict(False, "picture")
        if body[-1] in _CLOSERS:
            # what closes at the very end was whole, unless the text met its limit there
            return self._asked(0.2, False, "closed") if prior > 0.8 else Verdict(False, "closed")
        if body[-1] in ",;:-–—/\\&+=<|":
            return Verdict(body[-1] not in ":" or prior > 0.5, "joint")
        if short_is_title and "\n" not in body.strip() and n_words(body) <= TITLE_WORDS and prior < 0.8:
            return Verdict(False, "title")
        if prior < 0.8 and _OPTION.match(self.line):
            prior = min(prior, OPTION_PRIOR)  # options are phrases, and end where sentences go on
        return self._asked(prior / (1 - prior), True, None)


def judge(text: str, model: Endings, prior: float = 0.3, short_is_title: bool = True) -> Verdict:
    """Whether ``text`` breaks off, and by what evidence, by the counts of ``model``.

    Null-like texts are no case. A mark counts unless its line is no more than an aside of one or two
    words. ``short_is_title`` takes a line of a few words for a title, unless a cut was likely from the start.
    """
    seen = Reading(text)
    found = seen.verdict(prior, short_is_title)
    if found.cut is not None:
        return found
    chance = model.answer(seen.question)
    cut = chance < found.limit * (model.usual if found.of_usual else 1.0)
    return Verdict(cut, f"{chance:.3f}" if found.why is None else "sentence" if found.why == "number" and not cut else found.why)
