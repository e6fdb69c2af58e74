"""English stems (the second Porter algorithm), for arrays of words in Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_V = "aeiouy"
# Fixed values of the published algorithm: words with stems of their own, words left as they are, and the suffixes of its steps.
_OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
_KEPT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_KEPT_LATER = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _after(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _short(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _V and word[1] not in _V
    return len(word) > 2 and word[-3] not in _V and word[-2] in _V and word[-1] not in _V + "wxY"


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2 or word in _KEPT:
        return word
    if word in _OWN:
        return _OWN[word]
    w = word.lstrip("'") or word
    w = re.sub(r"(?:^|(?<=[aeiouy]))y", "Y", w)
    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _after(w, 0)
    second = _after(w, first)
    w = re.sub("(?:'s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT_LATER:
        return w
    if m := re.search("(eedly|eed)$", w):
        if m.start() >= first:
            w = w[: m.start()] + "ee"
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and any(c in _V for c in w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
        elif _short(w) and first >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for suffix, into in _STEP2.items():
        if w.endswith(suffix):
            if len(w) - len(suffix) >= first:
                w = w[: -len(suffix)] + into
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= first and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= first and w[-3:-2] and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    for suffix, into in _STEP3.items():
        if w.endswith(suffix):
            if len(w) - len(suffix) >= first:
                w = w[: -len(suffix)] + into
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= second:
            w = w[:-5]
    for suffix in _STEP4:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= second:
                w = w[: -len(suffix)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= second and w[-4:-3] and w[-4] in "st":
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= second or len(w) - 1 >= first and not _short(w[:-1])):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= second and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(ArrayType(StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda row: None if row is None else list(dict.fromkeys(map(stem, row))))


def stems(words: Column) -> Column:
    """The distinct stems of an array of words, in order. Stems of frequent words are kept in each worker; nothing is shuffled."""
    return _stems(words)
