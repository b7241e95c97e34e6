"""The public Porter algorithm (1980) for English word stems."""

from __future__ import annotations

import re
from functools import lru_cache

_C, _V = "(?:[^aeiouy]|(?<![^aeiou])y|^y)", "(?:[aeiou]|(?<=[^aeiou])y)"
_M1 = re.compile(f"^(?:{_C}+)?{_V}+{_C}")
_M2 = re.compile(f"^(?:{_C}+)?(?:{_V}+{_C}+){{2}}")
_M_IS_1 = re.compile(f"^(?:{_C}+)?{_V}+{_C}+(?:{_V}+)?$")
_HAS_V = re.compile(_V)
_CVC = re.compile(f"{_C}{_V}[^aeiouwxy]$")
# The suffixes of the algorithm's second to fourth step.
_STEP2 = dict(zip("ational tional enci anci izer abli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti".split(), "ate tion ence ance ize able al ent e ous ize ate ate al ive ful ous al ive ble".split(), strict=True))
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words under three letters and with other than a-z stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _M1.match(word[:-3]) else word
    else:
        cut = 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0
        if cut and _HAS_V.search(word[:-cut]):
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
                word = word[:-1]
            elif _M_IS_1.match(word) and _CVC.search(word):
                word += "e"
    if word.endswith("y") and _HAS_V.search(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        ending = max((s for s in table if word.endswith(s)), key=len, default=None)
        if ending and _M1.match(word[: -len(ending)]):
            word = word[: -len(ending)] + table[ending]
    ending = max((s for s in _STEP4 if word.endswith(s)), key=len, default=None)
    if ending and _M2.match(word[: -len(ending)]) and (ending != "ion" or word[: -len(ending)].endswith(("s", "t"))):
        word = word[: -len(ending)]
    if word.endswith("e"):
        rest = word[:-1]
        if _M2.match(rest) or (_M1.match(rest) and not _CVC.search(rest)):
            word = rest
    if word.endswith("ll") and _M2.match(word[:-1]):
        word = word[:-1]
    return word
