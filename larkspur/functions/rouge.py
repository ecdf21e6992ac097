"""ROUGE-L (longest common subsequence), batched through Arrow; a row of the table is the bits of a whole number."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.shared import give_back

WORD = re.compile("[a-z0-9]+")
VOWEL = "aeiou"


def _cons(w: str, i: int) -> bool:
    return w[i] not in VOWEL and not (w[i] == "y" and i > 0 and _cons(w, i - 1))


def _measure(stem: str) -> int:
    forms = "".join("c" if _cons(stem, i) else "v" for i in range(len(stem)))
    return len(re.findall("v+c+", forms))


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _cvc(w: str) -> bool:
    return len(w) > 2 and _cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1) and w[-1] not in "wxy"


#: The suffix tables of the published algorithm.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def stem(w: str) -> str:
    """Porter's stemmer for words of over three letters."""
    if len(w) <= 3:
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for end, new in sorted((x.split(":") for x in table.split()), key=lambda p: -len(p[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted([*STEP4.split(), "ion"], key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one row of the table as the bits of a whole number."""
    places: dict[str, int] = {}
    for i, t in enumerate(b):
        places[t] = places.get(t, 0) | 1 << i
    every = (1 << len(b)) - 1
    row = every
    for t in a:
        hit = row & places.get(t, 0)
        row = (row + hit | row - hit) & every
    return len(b) - row.bit_count()


def rouge_l(prediction: Column | str, truth: Column | str, stemmed: bool = True) -> Column:
    """The F measure of ROUGE-L; 0 where either side has no word."""

    @F.arrow_udf("double")
    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        def words(s: str | None) -> list[str]:
            found = WORD.findall((s or "").lower())
            return [stem(w) for w in found] if stemmed else found

        for p, t in pairs:
            out = np.zeros(len(p))
            for i, (x, y) in enumerate(zip(p, t, strict=True)):  # a row's texts at a time
                a, b = words(x.as_py()), words(y.as_py())
                n = lcs(a, b) if a and b else 0
                out[i] = 2.0 * n / (len(a) + len(b)) if n else 0.0
            yield pa.array(out)
        give_back()

    return run(prediction, truth)
