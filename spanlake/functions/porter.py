"""The Porter stemmer, from its published description (1980)."""

from __future__ import annotations

VOWELS = "aeiou"

#: Endings of steps 2 to 4 of the published algorithm.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def consonant(w: str, i: int) -> bool:
    if w[i] in VOWELS:
        return False
    return w[i] != "y" or i == 0 or not consonant(w, i - 1)


def form(w: str) -> str:
    """The word as c and v."""
    out: list[str] = []
    for i, ch in enumerate(w):
        vowel = ch in VOWELS or ch == "y" and i > 0 and out[i - 1] == "c"
        out.append("v" if vowel else "c")
    return "".join(out)


def measure(w: str) -> int:
    return form(w).count("vc")


def double_end(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and form(w)[-1] == "c"


def short_end(w: str) -> bool:
    return len(w) > 2 and form(w)[-3:] == "cvc" and w[-1] not in "wxy"


def stem(w: str) -> str:
    """The stem of a lower-case word of ASCII letters; anything else is its own stem."""
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in form(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double_end(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in form(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if measure(base) > 1 or measure(base) == 1 and not short_end(base):
            w = base
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w
