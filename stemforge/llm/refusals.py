"""Refusals, by a grammar: openers, a speaker, what the speaker cannot, and set phrases.

The grammar is data. A rule has alternatives, an alternative is a row of symbols: a word stands for
itself, ``<name>`` for a rule, ``?`` and ``*`` behind a symbol make it optional or repeat it, ``..n`` is a
gap of up to n words, ``!word`` says that the word does not follow, ``$`` is the end of the sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

#: How responses decline to respond, by language.
RULES: dict[str, list[str]] = {
    "refusal": ["<opener>* <speaker> !be !see !recall", "<opener>* <phrase>", "<german>", "<french>", "<spanish>", "<chinese>", "<japanese>"],
    "apology": ["<sorry> <sign>* $", "<german_sorry> <sign>* $", "<french_sorry> <sign>* $", "<spanish_sorry> <sign>* $"],
    "sign": [",", ";", ":", ".", "!", "-", "–", "—"],
    "opener": ["<lead_in> <sign>? <link>? <sign>? <regret>? <sign>?"],
    "link": ["but", "however", "and", "so", "that"],
    "regret": ["unfortunately", "regrettably", "sadly"],
    "lead_in": ["<sorry>", "<regret>", "<as_machine>", "i understand ..12", "i appreciate ..12", "thank you for <kindness>", "thanks for <kindness>", "hello", "hi", "well", "no"],
    "sorry": ["<be>? <much>? sorry", "i apologize", "i apologise", "<my>? sincere? apologies"],
    "be": ["i'm", "i am", "we're", "we are"],
    "much": ["very", "so", "truly", "really"],
    "my": ["my", "our"],
    "kindness": ["asking", "your ..1"],
    "as_machine": ["as an <machine>", "as a <machine>", "being an <machine>", "being a <machine>"],
    "machine": ["..3 ai <kind>*", "..3 language model", "..3 assistant", "..3 chatbot", "..3 bot"],
    "kind": ["assistant", "language model"],
    "speaker": ["i <cannot>", "we <cannot>", "i'm <unable>", "we're <unable>", "i'd <rather> not", "i'll have to <ly>? <decline>", "we'll have to <ly>? <decline>"],
    "cannot": ["can not", "cannot", "can't", "could not", "couldn't", "am <unable>", "are <unable>", "won't", "won't be able to", "will not", "will not be able to", "<must> <ly>? <decline>", "decline", "refuse", "would <rather> not", "prefer not", "do not <lack>", "don't <lack>", "should not", "shouldn't", "may not"],
    "unable": ["unable to", "not able to", "not allowed", "not permitted", "not comfortable", "not going to", "not in a position"],
    "must": ["must", "have to", "need to", "will have to", "would like to"],
    "ly": ["respectfully", "politely", "kindly", "regretfully", "unfortunately", "therefore", "simply"],
    "decline": ["decline", "refuse", "pass", "refrain"],
    "rather": ["rather", "prefer"],
    "lack": ["feel <much>? comfortable", "feel <much>? able", "have access", "have enough", "have the ability", "have the information", "provide", "answer", "help", "wish", "want to", "think i can", "think i should"],
    "phrase": ["<it> <barred> ..8 <mine>", "no <reply> <modal> be <given>", "my <policy> ..6 <keep>", "<this> that? i <have_to>", "you will? <need> to <turn>", "you'll <need> to <turn>", "please <turn> <someone>"],
    "far": ["..8 <lies> <outside> of? <scope>"],
    "it": ["it is", "it's", "it would be", "that is", "that's", "that would be", "this is", "this would be"],
    "barred": ["not possible", "impossible", "beyond", "outside", "against"],
    "mine": ["me", "my", "i", "us"],
    "reply": ["answer", "response", "reply", "solution", "explanation"],
    "modal": ["can", "could", "will", "may"],
    "given": ["given", "provided", "offered", "written"],
    "policy": ["guidelines", "rules", "instructions", "policy", "policies", "programming"],
    "keep": ["keep", "prevent", "forbid", "prohibit", "stop", "do not allow", "do not permit", "don't allow", "don't permit"],
    "this": ["this is something", "that is something", "this request is something", "that request is something", "this is a request", "that is a request", "this question is one", "that question is one"],
    "have_to": ["have to", "must", "can not", "cannot", "can't", "am"],
    "need": ["need", "have", "want"],
    "turn": ["ask", "consult", "contact", "see", "turn to"],
    "someone": ["a", "your", "someone"],
    "lies": ["is", "are", "falls", "fall", "lies"],
    "outside": ["outside", "beyond"],
    "scope": ["what i", "my", "the scope of what i"],
    "german": ["<german_sorry>", "leider <darf>", "leider ist es mir", "als ki", "als sprachmodell", "als assistent", "<german_object> ..4 <darf> ich ..10 <german_not>", "ich <darf> ..10 <german_not>", "ich werde ..10 <german_not>", "es ist mir leider? nicht möglich", "ich bin nicht in der lage", "meine richtlinien"],
    "german_sorry": ["es tut mir leid", "tut mir leid", "es tut mir sehr leid"],
    "german_object": ["das", "dies", "diese", "dieses", "dieser", "dabei", "dazu", "darauf", "hierzu"],
    "darf": ["kann", "darf", "möchte", "will"],
    "german_not": ["nicht", "kein", "keine", "keinen", "lieber nicht"],
    "french": ["<french_sorry>", "malheureusement ,? je", "je ne? <peux> ..6 <french_not>", "en tant que", "en tant qu'..1", "il m'est impossible", "il ne m'est pas possible", "mes consignes", "je regrette"],
    "french_sorry": ["je suis vraiment? désolé", "je suis vraiment? désolée", "désolé", "désolée"],
    "peux": ["peux", "puis", "suis", "souhaite", "préfère", "dois", "veux", "saurais"],
    "french_not": ["pas", "refuser", "décliner"],
    "spanish": ["<spanish_sorry>", "lamentablemente", "como modelo", "como asistente", "como ia", "con ..6 no puedo", "sin ..6 no puedo", "me? temo que no <puedo>", "no <puedo>", "prefiero no", "mis normas", "mis directrices"],
    "spanish_sorry": ["lo siento", "lamento", "disculpa", "disculpe"],
    "puedo": ["puedo", "me es posible", "estoy en condiciones", "quiero", "debo", "se me permite"],
    "chinese": ["<chinese_sorry>", "作为 一个? 人工智能", "作为 一个? ai", "作为 一个? 语言模型", "我无法", "我不能", "我不便", "无法回答"],
    "chinese_sorry": ["抱歉", "对不起", "很遗憾", "不好意思", "很抱歉", "非常抱歉"],
    "japanese": ["申し訳", "すみません", "すいません", "残念ながら", "ごめんなさい", "<japanese_self>? ai <japanese_being>", "<japanese_self>? 言語モデル <japanese_being>", "お答えできません", "お答えいたしかねます", "その質問には"],
    "japanese_self": ["私は"],
    "japanese_being": ["として", "なので"],
}
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W\d_぀-ヿ㐀-鿿]+(?:'[^\W\d_]+)*|\d+|[^\w\s]")
_BEGIN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W\d_぀-ヿ㐀-鿿]+(?:'[^\W\d_]+)*|\d+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")


class Grammar:
    """Recognises beginnings of token rows by rules like :data:`RULES`."""

    def __init__(self, rules: dict[str, list[str]]):
        self.rules = {name: [list(self._symbols(a)) for a in alternatives] for name, alternatives in rules.items()}
        self.first = {name: self._first_of(name) for name in rules}

    @staticmethod
    def _symbols(alternative: str) -> Iterator[tuple[str, object, str]]:
        """(kind, value, repeat) of each symbol; a word of several tokens becomes several symbols."""
        for part in alternative.split():
            if part.startswith("..") and part[2:].isdigit():
                yield "gap", int(part[2:]), ""
                continue
            repeat = part[-1] if part[-1] in "?*" else ""
            part = part.removesuffix(repeat) if repeat else part
            if part == "$":
                yield "end", None, ""
            elif part.startswith("<"):
                yield "rule", part[1:-1], repeat
            elif part.startswith("!") and len(part) > 1:
                yield "not", part[1:], ""
            elif part.endswith("'..1"):
                yield "begins", part[:-3], ""
            else:
                tokens = _TOKEN.findall(part)
                if len(tokens) > 1 and repeat:
                    yield "row", tuple(tokens), repeat
                else:
                    yield from (("word", t, repeat) for t in tokens)

    def _first_of(self, name: str) -> set[str] | None:
        """Tokens that the rule can begin with; None where it may be any."""
        out: set[str] = set()
        for alternative in self.rules[name]:
            for kind, value, repeat in alternative:
                if kind in ("gap", "begins"):
                    return None
                if kind == "rule":
                    inner = self._first_of(value)
                    if inner is None:
                        return None
                    out |= inner
                elif kind in ("word", "row"):
                    out.add(value if kind == "word" else value[0])
                if kind != "not" and not repeat:
                    break
        return out

    def matches(self, name: str, tokens: list[str]) -> bool:
        """Whether some beginning of ``tokens`` follows the rule."""
        known: dict[tuple[str, int], frozenset[int]] = {}

        def rule(name: str, at: int) -> frozenset[int]:
            if (name, at) not in known:
                known[name, at] = frozenset()  # no rule begins with itself
                first = self.first[name]
                if first is None or at < len(tokens) and tokens[at] in first:
                    known[name, at] = frozenset(e for a in self.rules[name] for e in row(a, at))
            return known[name, at]

        def one(kind: str, value: object, at: int) -> Iterator[int]:
            if kind == "rule":
                yield from rule(value, at)
            elif kind == "gap":
                yield from range(at, min(at + value, len(tokens)) + 1)
            elif kind == "end":
                yield from [at] if at == len(tokens) else []
            elif kind == "not":
                yield from [at] if at == len(tokens) or tokens[at] != value else []
            elif at < len(tokens):
                size = len(value) if kind == "row" else 1
                held = tokens[at : at + size] == list(value) if kind == "row" else tokens[at].startswith(value) if kind == "begins" else tokens[at] == value
                if held:
                    yield at + size

        def row(symbols: list, at: int) -> set[int]:
            ends = {at}
            for kind, value, repeat in symbols:
                reached = {e for s in ends for e in one(kind, value, s)}
                if repeat == "*":
                    seen, fresh = set(reached), reached
                    while fresh:
                        fresh = {e for s in fresh for e in one(kind, value, s)} - seen
                        seen |= fresh
                    reached = seen
                ends = reached | ends if repeat else reached
                if not ends:
                    break
            return ends

        return bool(rule(name, 0))


@lru_cache(maxsize=1)
def grammar() -> Grammar:
    return Grammar(RULES)


def is_refusal(text: str) -> bool:
    """Whether a sentence of the text declines to respond, or the text is an apology and no more."""
    known = grammar()
    lower = text.replace("’", "'").lower()
    first = known.first["refusal"]
    sentences = [s for s in _SENTENCE.split(lower) if s and not s.isspace()]
    for sentence in sentences:
        begin = _BEGIN.search(sentence)
        if begin is None:
            continue
        far = "outside" in sentence or "beyond" in sentence
        if begin.group() in first or far:
            tokens = _TOKEN.findall(sentence, begin.start())
            if known.matches("refusal", tokens) or far and known.matches("far", tokens):
                return True
    return len(sentences) == 1 and known.matches("apology", _TOKEN.findall(lower))
