"""Functions that built-in ones can't express, as Arrow UDFs over whole batches."""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def osa_distance(a: str, b: str) -> int:
    """Optimal string alignment: edits and swaps of neighbours, none edited twice."""
    prev2, prev = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, prev2[j - 2] + 1)
            row.append(best)
        prev2, prev = prev, row
    return prev[-1]


@F.pandas_udf(T.IntegerType())
def osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def jaro_of(a: str, b: str) -> float:
    """Jaro similarity: matches within half the longer length, less half the swaps, rounded down as in DuckDB."""
    if not a or not b:
        return 0.0 if a != b else 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, u in zip(b, used, strict=True) if u]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


@F.pandas_udf(T.DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def jaro_winkler(a: Column, b: Column, scale: float = 0.1, most: int = 4) -> Column:
    """Jaro, raised for a common prefix of up to so many letters, at any similarity."""
    same = F.aggregate(
        F.sequence(F.lit(1), F.lit(most)), F.lit(0), lambda n, i: n + F.when((n == i - 1) & (F.length(a) >= i) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), 1).otherwise(0)
    )
    base = jaro(a, b)
    return base + same * scale * (1 - base)


# First letters of which one is silent, and what they sound like; letters with one sound.
_STARTS = {"AE": "E", "GN": "N", "KN": "N", "PN": "N", "WR": "R", "WH": "W", "X": "S"}
_PLAIN = {"F": "F", "J": "J", "L": "L", "M": "M", "N": "N", "Q": "K", "R": "R", "V": "F", "X": "KS", "Z": "S"}
_VOWELS, _FRONT = set("AEIOU"), set("EIY")


def metaphone_of(word: str) -> str:
    """Metaphone as Lawrence Philips published it in 1990: vowels are kept at the start only."""
    letters = re.sub(r"([^C])\1+", r"\1", re.sub("[^A-Z]", "", word.upper()))
    for start, sound in _STARTS.items():
        if letters.startswith(start):
            letters = sound + letters[len(start) :]
            break
    return "".join(_sound(letters, i) for i in range(len(letters)))


def _sound(w: str, i: int) -> str:
    """What the letter at a place sounds like, by the letters around it."""
    c, rest = w[i], w[i + 1 :]
    before, after, then = w[i - 1 : i], rest[:1], rest[1:2]
    if c in _VOWELS:
        return c if i == 0 else ""
    if c in _PLAIN:
        return _PLAIN[c]
    if c == "B":
        return "" if before == "M" and not rest else "B"
    if c == "C":
        if before == "S" and after in _FRONT:
            return ""
        if rest.startswith("IA") or (after == "H" and before != "S"):
            return "X"
        return "S" if after in _FRONT and after else "K"
    if c == "D":
        return "J" if after == "G" and then in _FRONT and then else "T"
    if c == "G":
        silent = (after == "H" and then not in _VOWELS) or rest in ("N", "NED") or (before == "D" and after in _FRONT and after)
        return "" if silent else "J" if after and after in _FRONT and before != "G" else "K"
    if c == "H":
        return "" if before and before in "CSPTG" or after not in _VOWELS or not after else "H"
    if c == "K":
        return "" if before == "C" else "K"
    if c == "P":
        return "F" if after == "H" else "P"
    if c == "S":
        return "X" if after == "H" or rest[:2] in ("IO", "IA") else "S"
    if c == "T":
        return "X" if rest[:2] in ("IO", "IA") else "0" if after == "H" else "" if rest.startswith("CH") else "T"
    return c if after and after in _VOWELS else ""  # W and Y


@F.pandas_udf(T.StringType())
def metaphone(word: pd.Series) -> pd.Series:
    return word.map(metaphone_of)


# The stemmer's suffixes, each tried in this order.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(s: str) -> str:
    """v and c for vowels and consonants; y is a vowel after consonants, but not at the start."""
    return "".join("v" if c in "aeiou" or (c == "y" and i and s[i - 1] not in "aeiou") else "c" for i, c in enumerate(s))


def _measure(s: str) -> int:
    """How often a vowel follows a consonant."""
    return _shape(s).count("cv")


def _closed(s: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x and y."""
    return bool(re.search(r"[^aeiou][aeiou][^aeiouwxy]\Z", s))


def stem_of(word: str) -> str:
    """A simplified Porter stemmer, in which the measure counts consonant-vowel steps."""
    w = word.lower()
    if len(w) <= 2:
        return w
    w = re.sub(r"(ss)es\Z|(i)es\Z|(ss)\Z|s\Z", lambda m: m[1] or m[2] or m[3] or "", w)
    cut = re.search(r"(eed|ed|ing)\Z", w)
    if cut and cut[1] == "eed":
        w = w[:-1] if _measure(w[:-3]) else w
    elif cut and "v" in _shape(w[: cut.start()]):
        w = w[: cut.start()]
        if re.search(r"(at|bl|iz)\Z", w):
            w += "e"
        elif re.search(r"([^aeioulsz])\1\Z", w):
            w = w[:-1]
        elif _measure(w) == 1 and _closed(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        hit = next(((s, r) for s, r in table if w.endswith(s)), None)
        if hit and _measure(w[: -len(hit[0])]):
            w = w[: -len(hit[0])] + hit[1]
    suffix = next((s for s in _STEP4 if w.endswith(s)), None)
    if suffix and _measure(w[: -len(suffix)]) > 1:
        w = w[: -len(suffix)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _closed(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.pandas_udf(T.StringType())
def porter_simplified(word: pd.Series) -> pd.Series:
    return word.map(stem_of)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t.lower()))


def hash_embed(text: str, dim: int = 384) -> np.ndarray:
    """Signed counts of hashed character trigrams, each spread over eight places; length one."""
    import xxhash

    low = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text.lower())
    v = np.zeros(dim)
    grams = [low[i : i + 3] for i in range(len(low) - 2)] if len(low) > 3 else [low] * bool(low)
    spread = min(8, dim)
    for g in grams:
        h = xxhash.xxh64(g.encode()).intdigest()
        for i in range(spread):
            v[(h + i * 0x9E3779B97F4A7C15) % dim] += 1.0 if h >> i & 1 else -1.0
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def hash_embedder(dim: int = 384):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: hash_embed(t or "", dim).astype("float32"))

    return embed


# --- JSON that a model wrote


def close_containers(s: str) -> str | None:
    """The text with the closing brackets it lacks at its end, or None if that isn't all that's wrong."""
    plain = re.sub(r'"(?:\\.|[^"\\])*"', "", s, flags=re.S)
    if '"' in plain:
        return None
    open_: list[str] = []
    for c in re.findall(r"[{}\[\]]", plain):
        if c in "{[":
            open_.append("}" if c == "{" else "]")
        elif not open_ or open_.pop() != c:
            return None
    return s + "".join(reversed(open_)) if open_ else None


def json_object(text: str | None) -> dict | None:
    """The first object in a model's answer: fences and talk around it are ignored, and small damage is mended."""
    s = (text or "").strip()
    fenced = re.fullmatch(r"```(?:json)?\s*(.*?)```", s, flags=re.S)
    s = fenced[1] if fenced else s
    s = s[s.find("{") :] if "{" in s else ""
    for attempt in (s, close_containers(s), re.sub(r",\s*([}\]])", r"\1", s), close_containers(re.sub(r",\s*\Z", "", s)) or ""):
        if attempt:
            try:
                obj, _ = json.JSONDecoder().raw_decode(attempt)
            except ValueError:
                continue
            return obj if isinstance(obj, dict) else None
    return None


@F.pandas_udf(T.StringType())
def extract_json(text: pd.Series) -> pd.Series:
    """The object as JSON text, or null."""
    found = text.map(json_object)
    return found.map(lambda o: None if o is None else json.dumps(o, ensure_ascii=False, sort_keys=True))
