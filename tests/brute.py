"""Plain Python models of the counting rules, for short texts."""

import re
from collections import Counter
from itertools import combinations

UNITS = ("second", "minute", "hour", "day", "week", "month", "year", "decade")


def is_number(token, limit=6):
    return re.fullmatch(rf"\d{{1,{limit}}}", token) is not None


def keyword(token):
    low = token.lower()
    if low in ("plus", "+", "minus", "-", "times", "*"):
        return low
    for unit in UNITS:
        if low in (unit, unit + "s"):
            return unit
    return None


def number_tuples(texts, k, w=5):
    """Choices of k numbers whose first and last are less than w tokens apart."""
    out = Counter()
    for text in texts:
        spots = [(i, t) for i, t in enumerate(text.split()) if is_number(t)]
        for chosen in combinations(spots, k):
            if chosen[-1][0] - chosen[0][0] < w:
                out[tuple(sorted(t for _, t in chosen))] += 1
    return out


def keyword_tuples(texts, k, w=5):
    """Choices of k numbers and one keyword, all less than w tokens apart."""
    out = Counter()
    for text in texts:
        tokens = text.split()
        spots = [(i, t) for i, t in enumerate(tokens) if is_number(t)]
        words = [(i, keyword(t)) for i, t in enumerate(tokens) if keyword(t)]
        for chosen in combinations(spots, k):
            for at, word in words:
                places = [i for i, _ in chosen] + [at]
                if max(places) - min(places) < w:
                    out[(*sorted(t for _, t in chosen), word)] += 1
    return out


def arithmetic(texts):
    out = Counter()
    for text in texts:
        tokens = text.split()
        for i in range(len(tokens) - 4):
            x, y, z = tokens[i], tokens[i + 2], tokens[i + 4]
            if is_number(x) and y.isdecimal() and z.isdecimal():
                out[(x, y, z)] += 1
    return out


def windows(text, w):
    tokens = text.split()
    pad = ["NONEWORD"] * (w - 1)
    padded = pad + tokens + pad
    return [padded[i : i + 2 * w - 1] for i in range(len(tokens))]
