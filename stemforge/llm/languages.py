"""The language of a short text, from its script and its function words."""

from __future__ import annotations

import re
from functools import lru_cache

#: Function words by language, without those that several of the languages share.
FUNCTION_WORDS = {
    "en": "the and of is that with for which this from by as at are be it its because before after when does would could should not only other what how why into than then both every each has have had was were if while whether there their they will can must all still to an or if been being did does these those such some any you your we our us he she his him her i am over under about between through during may might shall nor very just also here too own more most less much many few no",
    "de": "der das und ist nicht mit für dem den ein eine einen einer eines zu auf wird sich auch als bei nach wenn weil dass kann noch nur wird werden sind vom zum zur über unter zwischen aus durch wie oder aber man hier keine kein muss darf es im am beim ohne sobald wieder warum wodurch dafür sein ihre wurde sondern vor bis wieder",
    "fr": "le les et est que dans qui pour une du au aux sur par avec ce cette ces pas plus ne sont être ont mais où comme sans leur leurs il elle nous vous je quand dès afin ainsi fait même moment des dont après avant chaque jusqu si alors encore peut tout très lorsque deux cela pourquoi comment",
    "es": "el los las y que en por con una del al como más pero sus es son está no lo se para este esta estos estas cuando porque muy sin sobre entre también hasta desde donde qué cómo quién ha han si ya todo hay ser fue cada después usar otra otro mismo misma siguiente",
    "it": "il gli che di è non per una della dello delle nel nella sono con come più ma anche questo questa dove quando perché senza dopo prima ogni essere",
    "pt": "os as um uma não que em para com por mais dos das ao à pelo pela são como mas também quando porque sem sobre até onde ser foi cada depois",
    "nl": "het een en van is niet met voor dat op te zijn wordt ook als bij naar omdat kan nog maar deze dit door over uit geen moet",
}
_OF_WORD: dict[str, list[str]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in dict.fromkeys(_words.split()):
        _OF_WORD.setdefault(_word, []).append(_language)
#: Elided articles and the like, before an apostrophe.
_ELIDED = {"l": "fr", "d": "fr", "qu": "fr", "n": "fr", "j": "fr", "c": "fr", "s": "fr", "jusqu": "fr"}
_WORD, _APOSTROPHE = re.compile(r"[^\W\d_]+"), re.compile(r"(?<![^\W\d_])([^\W\d_]+)['’]([^\W\d_]{2,})")
_QUOTED = re.compile(r"[“„«][^”“»]{0,200}[”“»]|\"[^\"]{0,200}\"|[「『][^」』]{0,200}[」』]|`[^`]{0,200}`")
_KANA, _HAN, _HANGUL = re.compile("[぀-ヿ]"), re.compile("[㐀-鿿]"), re.compile("[가-힣]")
_OTHER_SCRIPTS = (("ru", re.compile("[Ѐ-ӿ]")), ("el", re.compile("[Ͱ-Ͽ]")), ("ar", re.compile("[؀-ۿ]")), ("he", re.compile("[֐-׿]")), ("hi", re.compile("[ऀ-ॿ]")), ("th", re.compile("[฀-๿]")))
#: Letters that point to a language, with its weight of half a function word.
_LETTERS = {"ß": "de", "ä": "de", "ö": "de", "ü": "de", "ñ": "es", "¿": "es", "¡": "es", "ç": "fr", "è": "fr", "ê": "fr", "œ": "fr", "ù": "fr", "û": "fr", "à": "fr", "ã": "pt", "õ": "pt"}


def scores(text: str) -> dict[str, float]:
    """Evidence by language; none where nothing speaks for one, as in names, numbers and letters.

    Quoted parts are not looked at. Scripts decide alone where they hold a third of the letters.
    """
    if not text.isascii():
        text = _QUOTED.sub(" ", text)
        letters = sum(map(str.isalpha, text)) or 1
        kana, han, hangul = (len(p.findall(text)) for p in (_KANA, _HAN, _HANGUL))
        if 3 * (kana + han + hangul) >= letters and kana + han + hangul:
            return {"ko" if hangul > kana + han else "ja" if 10 * kana >= kana + han else "zh": 9.0}
        for name, pattern in _OTHER_SCRIPTS:
            if (n := len(pattern.findall(text))) and 3 * n >= letters:
                return {name: 9.0}
    elif '"' in text or "`" in text:
        text = _QUOTED.sub(" ", text)
    out: dict[str, float] = {}
    lower = text.lower()
    words = _WORD.findall(lower)
    for w in words:
        if w in _OF_WORD:
            names = _OF_WORD[w]
            for name in names:
                out[name] = out.get(name, 0.0) + (1.0 if len(names) == 1 else 0.5)
    if "'" in lower or "’" in lower:
        for w, following in _APOSTROPHE.findall(lower):
            if w in _ELIDED:
                out["fr"] = out.get("fr", 0.0) + 1.0
    if not lower.isascii():
        for c, name in _LETTERS.items():
            if c in lower:
                out[name] = out.get(name, 0.0) + 0.5
    return out


@lru_cache(maxsize=16)
def language(text: str) -> str | None:
    """The language that clearly leads, if any."""
    found = scores(text)
    if not found:
        return None
    best = max(found, key=lambda n: (found[n], n))
    return best if found[best] > 1.5 * max((v for n, v in found.items() if n != best), default=0.0) else None


def differs(text: str, other: str) -> bool:
    """Whether ``text`` is in another language than ``other``, as far as both have one.

    It need not be clear which other language it is. A few words need one sign, longer texts two.
    """
    mine = scores(text)
    if not mine:
        return False
    most = max(mine.values())
    if most < (1.0 if len(text.split()) <= 5 else 2.0):
        return False
    theirs = language(other)
    return theirs is not None and mine.get(theirs, 0.0) * 1.5 < most
