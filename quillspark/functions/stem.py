"""Suffix stripping of English words after Porter's published algorithm, as one native expression.

A rule is a suffix, a condition on what stands before it, and what takes its place; of a step's rules only the one with the longest
suffix that the word has is tried. A y after a consonant is a vowel; it is written Y while a word is stemmed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conditions on a stem (vowels are aeiouY), and the steps' rules.
CONDITIONS = {
    "": "",
    "m>0": "^[^aeiouY]*[aeiouY]+[^aeiouY]",
    "m>1": "^[^aeiouY]*[aeiouY]+[^aeiouY]+[aeiouY]+[^aeiouY]",
}
M1 = "^[^aeiouY]*[aeiouY]+[^aeiouY]+[aeiouY]*$"
SHORT = "[^aeiouY][aeiouY][^aeiouYwxy]$"
STEP_1A = [("sses", "", "ss"), ("ies", "", "i"), ("ss", "", "ss"), ("s", "", "")]
STEP_2 = [
    ("ational", "m>0", "ate"), ("tional", "m>0", "tion"), ("enci", "m>0", "ence"), ("anci", "m>0", "ance"), ("izer", "m>0", "ize"), ("abli", "m>0", "able"), ("alli", "m>0", "al"),
    ("entli", "m>0", "ent"), ("eli", "m>0", "e"), ("ousli", "m>0", "ous"), ("ization", "m>0", "ize"), ("ation", "m>0", "ate"), ("ator", "m>0", "ate"), ("alism", "m>0", "al"),
    ("iveness", "m>0", "ive"), ("fulness", "m>0", "ful"), ("ousness", "m>0", "ous"), ("aliti", "m>0", "al"), ("iviti", "m>0", "ive"), ("biliti", "m>0", "ble"),
]
STEP_3 = [("icate", "m>0", "ic"), ("ative", "m>0", ""), ("alize", "m>0", "al"), ("iciti", "m>0", "ic"), ("ical", "m>0", "ic"), ("ful", "m>0", ""), ("ness", "m>0", "")]
STEP_4 = [(s, "m>1", "") for s in ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]]


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def ruled(word: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The word after the rule with its longest suffix."""
    out = None
    for suffix, condition, to in sorted(rules, key=lambda r: -len(r[0])):
        stem = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        new = F.concat(stem, F.lit(to))
        value = new if not condition else F.when(stem.rlike(CONDITIONS[condition]), new).otherwise(word)
        out = F.when(word.endswith(suffix), value) if out is None else out.when(word.endswith(suffix), value)
    return out.otherwise(word)


def _without(word: Column, suffix: str) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - len(suffix))


def _mended(stem: Column) -> Column:
    """After -ed or -ing: an e comes back, or a double consonant becomes single."""
    double = stem.rlike("(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$")
    back = stem.endswith("at") | stem.endswith("bl") | stem.endswith("iz") | (stem.rlike(M1) & stem.rlike(SHORT))
    return F.when(back & ~double, F.concat(stem, F.lit("e"))).when(double, _without(stem, "x")).otherwise(stem)


def _step_1b(w: Column) -> Column:
    vowel = lambda s: _without(w, s).rlike("[aeiouY]")
    ed = F.when(vowel("ed"), bound(_without(w, "ed"), _mended)).otherwise(w)
    ing = F.when(vowel("ing"), bound(_without(w, "ing"), _mended)).otherwise(w)
    eed = F.when(_without(w, "eed").rlike(CONDITIONS["m>0"]), _without(w, "d")).otherwise(w)
    return F.when(w.endswith("eed"), eed).when(w.endswith("ed"), ed).when(w.endswith("ing"), ing).otherwise(w)


def _step_1c(w: Column) -> Column:
    ends = w.endswith("y") | w.endswith("Y")
    return F.when(ends & _without(w, "y").rlike("[aeiouY]"), F.concat(_without(w, "y"), F.lit("i"))).otherwise(w)


def _step_4(w: Column) -> Column:
    ion = F.when(_without(w, "ion").rlike("[st]$") & _without(w, "ion").rlike(CONDITIONS["m>1"]), _without(w, "ion")).otherwise(w)
    return F.when(w.endswith("ion"), ion).otherwise(ruled(w, STEP_4))


def _step_5a(w: Column) -> Column:
    stem = _without(w, "e")
    short = stem.rlike(M1) & stem.rlike(SHORT)
    return F.when(w.endswith("e") & (stem.rlike(CONDITIONS["m>1"]) | (stem.rlike(M1) & ~short)), stem).otherwise(w)


def _step_5b(w: Column) -> Column:
    return F.when(w.endswith("ll") & _without(w, "l").rlike(CONDITIONS["m>1"]), _without(w, "l")).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a word in lower case; words of one or two letters and words with other characters than a to z stay."""
    marked = F.regexp_replace(word, "([bcdfghjklmnpqrstvwxz])y", "$1Y")
    steps = [lambda w: ruled(w, STEP_1A), _step_1b, _step_1c, lambda w: ruled(w, STEP_2), lambda w: ruled(w, STEP_3), _step_4, _step_5a, _step_5b]
    done = F.lower(reduce(bound, steps, marked))
    return F.when(word.rlike("^[a-z]{3,}$"), done).otherwise(word)


def stemmed(tokens: Column, longer_than: int = 3) -> Column:
    """Tokens, of which those of more than ``longer_than`` letters are stemmed."""
    return F.transform(tokens, lambda t: F.when(F.length(t) > longer_than, stem(t)).otherwise(t))
