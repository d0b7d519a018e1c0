"""The English Snowball stemmer ("Porter 2"), from its published description."""

from __future__ import annotations

import re

_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_WHOLE = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
    "dying": "die", "lying": "lie", "tying": "tie",
}
_KEPT_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
    ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_ENDS2, _ENDS3 = (tuple(suffix for suffix, _ in step) for step in (_STEP2, _STEP3))
_LI = "cdeghkmnrt"
_REGION = re.compile(f"[{_V}][^{_V}]")
_CONSONANT_Y = re.compile(f"(?<=[{_V}])y")
_VOWELS = frozenset(_V)


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""

    def after(start: int) -> int:
        m = _REGION.search(w, start)
        return m.end() if m else len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if r1 is None:
        r1 = after(0)
    return r1, after(r1)


def _short_end(w: str) -> bool:
    """Whether w ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-3] not in _V and w[-2] in _V and w[-1] not in _V + "wxY"


def _has_vowel(w: str) -> bool:
    return not _VOWELS.isdisjoint(w)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own."""
    if len(word) <= 2:
        return word
    w = word.replace("’", "'").lstrip("'")
    if w in _WHOLE:
        return _WHOLE[w]
    if w.startswith("y"):
        w = "Y" + w[1:]
    w = _CONSONANT_Y.sub("Y", w)
    r1, r2 = _regions(w)

    for suffix in ("'s'", "'s", "'"):  # step 0
        if w.endswith(suffix):
            w = w[: -len(suffix)]
            break

    if w.endswith("sses"):  # step 1a
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in _KEPT_AFTER_1A:
        return w

    if w.endswith(("eedly", "eed")):  # step 1b
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        cut = next((len(s) for s in ("ingly", "edly", "ing", "ed") if w.endswith(s)), 0)
        if cut and _has_vowel(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif len(w) <= r1 and _short_end(w):
                w += "e"

    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:  # step 1c
        w = w[:-1] + "i"

    for suffix, to in _STEP2 if w.endswith(_ENDS2) else ():
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1 and (suffix != "ogi" or w[at - 1 : at] == "l") and (suffix != "li" or w[at - 1 : at] in tuple(_LI)):
                w = w[:at] + to
            break

    for suffix, to in _STEP3 if w.endswith(_ENDS3) else ():
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1 and (suffix != "ative" or at >= r2):
                w = w[:at] + to
            break

    for suffix in _STEP4 if w.endswith(_STEP4) else ():
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r2 and (suffix != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break

    if w.endswith("e"):  # step 5
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
