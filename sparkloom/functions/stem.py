"""English stemming by the Porter2 rules, for words in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# fixed values: words with stems of their own
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_KEPT_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# fixed values: endings and what they become, by step
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
_V, _N = "[aeiouy]", "[^aeiouy]"


def _regions(w: str) -> tuple[int, int]:
    """Starts of R1 and R2: after the first consonant that follows a vowel, and again."""
    m = re.match(r"gener|commun|arsen", w)
    r1 = m.end() if m else (m.end() if (m := re.search(_V + _N, w)) else len(w))
    m = re.search(_V + _N, w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _short(w: str, r1: int) -> bool:
    return r1 >= len(w) and re.search(rf"(?:{_N}{_V}[^aeiouywxY]|^{_V}{_N})$", w) is not None


def stem(w: str) -> str:
    w = w.lower().replace("’", "'")
    if len(w) <= 2:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    if w in _SAME:
        return w
    w = re.sub(r"^'", "", w)
    w = re.sub(rf"^y|(?<={_V})y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"(?:'s'|'s|')$", "", w)
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif not w.endswith(("us", "ss")) and w.endswith("s") and re.search(_V, w[:-2]):
        w = w[:-1]
    if w in _KEPT_AFTER_1A:
        return w
    # 1b: past forms
    m = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", w)
    if m:
        end, base = m[1], w[: m.start()]
        if end in ("eed", "eedly"):
            w = base + "ee" if m.start() >= r1 else w
        elif re.search(_V, base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif _short(w, r1):
                w += "e"
    # 1c: final y
    if len(w) > 2 and w[-1] in "yY" and re.match(_N, w[-2]):
        w = w[:-1] + "i"
    # 2, 3: derived endings in R1
    for n, table in ((2, _STEP2), (3, _STEP3)):
        ends = sorted([*table, *(("ogi", "li") if n == 2 else ("ative",))], key=len, reverse=True)
        e = next((e for e in ends if w.endswith(e)), None)
        if e is None or len(w) - len(e) < r1:
            continue
        base = w[: -len(e)]
        if e == "ogi":
            w = base + "og" if base.endswith("l") else w
        elif e == "li":
            w = base if base[-1:] in tuple("cdeghkmnrt") else w
        elif e == "ative":
            w = base if len(base) >= r2 else w
        else:
            w = base + table[e]
    # 4: endings in R2
    e = next((e for e in sorted([*_STEP4, "ion"], key=len, reverse=True) if w.endswith(e)), None)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[: -len(e)].endswith(("s", "t"))):
        w = w[: -len(e)]
    # 5: final e and l
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not re.search(rf"(?:{_N}{_V}[^aeiouywxY]|^{_V}{_N})$", w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem_de(w: str) -> str:
    """German: endings of inflection and derivation in their regions, umlauts to plain vowels."""
    w = re.sub(r"(?<=[aeiouyäöü])u(?=[aeiouyäöü])", "U", w.lower().replace("ß", "ss"))
    w = re.sub(r"(?<=[aeiouyäöü])y(?=[aeiouyäöü])", "Y", w)
    v, n = "[aeiouyäöü]", "[^aeiouyäöü]"
    m = re.search(v + n, w)
    first = m.end() if m else len(w)
    m = re.search(v + n, w[first:])
    r1, r2 = max(3, first), first + m.end() if m else len(w)
    if (m := re.search(r"(em|ern|er|en|es|e|(?<=[bdfghklmnrt])s)$", w)) and m.start() >= r1:
        w = w[: m.start()]
        if m[1] in ("en", "es", "e") and w.endswith("niss"):
            w = w[:-1]
    if (m := re.search(r"(est|en|er|(?<=.{3}[bdfghklmnt])st)$", w)) and m.start() >= r1:
        w = w[: m.start()]
    if (m := re.search(r"(isch|lich|heit|keit|end|ung|ig|ik)$", w)) and m.start() >= r2:
        base = w[: m.start()]
        if m[1] in ("end", "ung"):
            w = base[:-2] if base.endswith("ig") and not base.endswith("eig") and len(base) - 2 >= r2 else base
        elif m[1] in ("ig", "ik", "isch"):
            w = w if base.endswith("e") else base
        elif m[1] in ("lich", "heit"):
            w = base[:-2] if base.endswith(("er", "en")) and len(base) - 2 >= r1 else base
        else:
            w = base
            for e in ("lich", "ig"):
                if w.endswith(e) and len(w) - len(e) >= r2:
                    w = w[: -len(e)]
                    break
    return w.replace("U", "u").replace("Y", "y").replace("ä", "a").replace("ö", "o").replace("ü", "u")


STEMMERS = {"en": stem, "de": stem_de}


def stems(words: Column, lang: str = "en") -> Column:
    """Stems of an array of words; each different word of a batch is stemmed once."""
    one_stem = STEMMERS[lang]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(x: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def one(w: str) -> str:
            if w not in known:
                known[w] = one_stem(w)
            return known[w]

        return x.map(lambda ws: None if ws is None else [one(w) for w in ws])

    return run(words)
