"""Porter's stemming of English words (1980, with the two changes he published later).

A word is read as runs of vowels and consonants; the measure m of a stem is how often a consonant follows a
vowel. Five steps cut or replace endings whose stems have a measure, a vowel or a shape.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings and what replaces them where the stem has a measure of 1 at least.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Endings that go where the stem has a measure of 2 at least; "ion" only after s or t.
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
#: Words are left alone below 3 and beyond 64 bytes.
LEAST, MOST = 3, 64


def _shape(word: str) -> str:
    """``v`` or ``c`` for each letter; y is a vowel behind a consonant."""
    out: list[str] = []
    for c in word:
        vowel = c in "aeiou" or (c == "y" and bool(out) and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _has_vowel(word: str) -> bool:
    return "v" in _shape(word)


def _short(word: str) -> bool:
    """Consonant, vowel and consonant at the end, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, endings: dict[str, str], least: int) -> str:
    """The longest ending that the word has decides, whether its stem is measured enough or not."""
    for n in range(min(len(word), 7), 0, -1):
        end = word[-n:]
        if end in endings:
            stem = word[:-n]
            if _measure(stem) < least or (end == "ion" and stem[-1:] not in ("s", "t")):
                return word
            return stem + endings[end]
    return word


def _plural(word: str) -> str:
    if word.endswith("sses") or (word.endswith("ies") and len(word) > 3):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for end in ("ed", "ing"):
        if word.endswith(end):
            stem = word[: -len(end)]
            if not _has_vowel(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c" and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short(stem) else stem
    return word


@lru_cache(1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if not LEAST <= len(word.encode()) <= MOST:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(word, STEP2, 1)
    word = _replaced(word, STEP3, 1)
    word = _replaced(word, dict.fromkeys(STEP4, ""), 2)
    if word.endswith("e"):
        left = word[:-1]
        m = _measure(left)
        if m > 1 or (m == 1 and not _short(left)):
            word = left
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem_as(word: str, forms: Mapping[str, Sequence[str]]) -> str:
    """The stem of a word; empty if ``forms`` tells how its stem may be written and the word is written in another way."""
    found = stem(word)
    return found if word in forms.get(found, (word,)) else ""


def stem_lists(lists: pa.Array, forms: Mapping[str, Sequence[str]] | None = None) -> pa.Array:
    """Stems of lists of words: each distinct word of a batch is stemmed once, and its stem takes all of its places."""
    coded = lists.flatten().dictionary_encode()
    stems = pa.array([None if w is None else stem_as(w, forms or {}) for w in coded.dictionary.to_pylist()], pa.string())
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    ends = pc.cumulative_sum(lengths).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, stems.take(coded.indices), mask=lists.is_null())


def stemmed(words: Column, forms: Mapping[str, Sequence[str]] | None = None) -> Column:
    """A column of lists of words as lists of their stems; of a stem in ``forms`` only the words written so."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        return stem_lists(lists, forms)

    return run(words)
