"""A pushdown parser of what a text opens and must close: code, brackets, quotations, list items, markup.

One stack holds every kind. Blocks (fences, environments, displayed formulas, tags) stay open until they
are closed; what stands within a paragraph (brackets, quotations, emphasis, code spans) is given up
where the paragraph, the list item or the heading ends, for then it was a slip and not a cut.
"""

from __future__ import annotations

import re
from collections import defaultdict
from typing import NamedTuple

#: Brackets and quotation marks, opener to closers.
PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "（": "）", "【": "】"}
_CLOSERS = frozenset("".join(PAIRS.values()))
#: HTML elements without content, or whose end tag may be left out.
LONE_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr p li dt dd td th tr thead tbody tfoot option optgroup colgroup html head body".split())
#: Kinds of symbols that stay open over the end of a paragraph.
BLOCKS = frozenset(("fence", "environment", "formula", "tag"))

_SIGN = re.compile(
    r"""(?P<fence>\n[ \t]*(?:`{3,}|~{3,})[^\n]*)
    |(?P<item>\n[ \t>]*(?:(?:[-*+•‣]|\(?(?:\d{1,3}|[A-Za-z])[.)])(?=[ \t]|\n|\Z)|\#{1,6}[ ]))
    |(?P<blank>\n[ \t]*(?=\n))
    |(?P<begin>\\begin\{[\w*]+\})|(?P<end>\\end\{[\w*]+\})
    |(?P<formula>\$\$|\\\[|\\\])
    |(?P<tag></?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>)
    |(?P<half><(?:/[A-Za-z][A-Za-z0-9]*|[A-Za-z][A-Za-z0-9]*\s[^<>\n=]{1,40}=[^<>\n]*)\Z)
    |(?P<strong>\*\*|__)
    |(?P<code>`+)
    |(?P<straight>")
    |(?P<skip>\\.)
    |(?P<bracket>[()\[\]{}“”«»„「」『』（）【】])""",
    re.VERBOSE | re.DOTALL,
)

#: What a sign begins with; most lines begin none.
_FIRST = re.compile(r"""[`~\\$<*_"()\[\]{}“”«»„「」『』（）【】]|\n(?=[ \t>\n`~\-*+•‣#(]|(?:\d{1,3}|[A-Za-z])[.)](?:[ \t\n]|\Z))""")
_FENCE_END = {c: re.compile(rf"(?m)^[ \t]*{c}{{3,}}[ \t]*$") for c in "`~"}
_SPAN_END = re.compile(r"`+|\n[ \t]*(?=\n)")


class Symbol(NamedTuple):
    kind: str
    closer: str
    at: int


class _Stack:
    """Open symbols, and how many of each there are, so that a closer without an opener costs nothing."""

    def __init__(self) -> None:
        self.symbols: list[Symbol] = []
        self.held: defaultdict[tuple[str, str], int] = defaultdict(int)

    def open(self, kind: str, closer: str, at: int) -> None:
        self.symbols.append(Symbol(kind, closer, at))
        for c in closer if kind == "bracket" else (closer,):
            self.held[kind, c] += 1

    def _pop(self) -> Symbol:
        s = self.symbols.pop()
        for c in s.closer if s.kind == "bracket" else (s.closer,):
            self.held[s.kind, c] -= 1
        return s

    def close(self, kind: str, closer: str) -> bool:
        """Pops the innermost symbol with this closer, and with it what was opened inside of it."""
        if self.held.get((kind, closer), 0) <= 0:
            return False
        at = len(self.symbols) - 1
        while not (self.symbols[at].kind == kind and closer in (self.symbols[at].closer if kind == "bracket" else [self.symbols[at].closer])):
            if self.symbols[at].kind in BLOCKS and kind not in BLOCKS:
                return False  # what was opened before a block cannot end inside of it
            at -= 1
        while len(self.symbols) > at:
            self._pop()
        return True

    def give_up(self) -> None:
        """Forgets what a paragraph left open."""
        while self.symbols and self.symbols[-1].kind not in BLOCKS:
            self._pop()


def parse(text: str) -> list[Symbol]:
    """What is open at the end of ``text``, outermost first; closers without an opener are passed over."""
    text, stack = "\n" + text, _Stack()
    size, at = len(text), 0
    while first := _FIRST.search(text, at):
        m = _SIGN.match(text, first.start())
        if m is None:
            at = first.end()
            continue
        kind, begin, at = m.lastgroup, m.start(), m.end()
        if stack.symbols and stack.symbols[-1].kind == "fence":
            # within a fence nothing counts but the line that closes it
            closing = _FENCE_END[stack.symbols[-1].closer[0]].search(text, begin)
            if closing is None:
                break
            stack.close("fence", stack.symbols[-1].closer)
            at = closing.end()
            continue
        sign, before, after = m.group(), text[begin - 1 : begin], text[at : at + 1]
        if kind == "fence":
            stack.give_up()
            stack.open("fence", sign.strip()[:3], begin)
        elif kind == "blank":
            stack.give_up()
        elif kind == "item":
            stack.give_up()
            if at + 2 >= size and not text[at:].strip() and any(map(str.isalnum, sign)):
                stack.open("item", "", begin)  # the number of an item that never came
        elif kind == "begin":
            stack.open("environment", sign[7:-1], begin)
        elif kind == "end":
            stack.close("environment", sign[5:-1])
        elif kind == "formula":
            closer = "\\]" if sign == "\\[" else sign
            if sign == "\\[" or not stack.close("formula", closer) and sign == "$$":
                stack.open("formula", closer, begin)
        elif kind == "tag":
            name = re.match(r"</?(\w+)", sign).group(1).lower()
            if sign.startswith("</"):
                stack.close("tag", name)
            elif name not in LONE_TAGS and not sign.endswith("/>"):
                stack.open("tag", name, begin)
        elif kind == "half":
            stack.open("tag", ">", begin)
        elif kind == "strong":
            if not (before.strip() and stack.close("strong", sign)) and after.strip() and after not in "*_.,;:)" and not before.isalnum() and before not in ("*", "_"):
                stack.open("strong", sign, begin)
        elif kind == "code":
            # a span goes to its closing run within the paragraph, and nothing in it counts
            closing = _SPAN_END.search(text, at)
            while closing and closing.group().startswith("`") and closing.group() != sign:
                closing = _SPAN_END.search(text, closing.end())
            if closing is None:
                stack.open("code", sign, begin)
                break
            at = closing.end() if closing.group() == sign else closing.start()
        elif kind == "straight":
            if not stack.close("straight", sign) and not before.isdigit() and not (before.isalpha() and not after.isalnum()):
                stack.open("straight", sign, begin)
        elif kind == "bracket" and not (sign in _CLOSERS and stack.close("bracket", sign)) and sign in PAIRS:
            if not (sign in "([" and before and before in ":;-="):  # a face, not a bracket
                stack.open("bracket", PAIRS[sign], begin)
    return stack.symbols


def left_open(text: str) -> int:
    """How many symbols are open at the end of ``text``."""
    return len(parse(text))
