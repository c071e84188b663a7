"""Column expressions on text and tokens. Every one runs in the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters at which text is cut into tokens (Unicode white space and the
# four ASCII separators), as a regex class body without the blank, and one by one.
WS_CLASS = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# The blank (and printable ASCII) come first in the unions because they decide most characters.
WS = f"[ [{WS_CLASS}]]"
NOT_WS = f"[!-~[^ {WS_CLASS}]]"

PADDING = "NONEWORD"  # fixed value: fills windows beyond the ends of a text


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def tokenize(text: Column) -> Column:
    """Whitespace tokens of ``text``; never an empty token, ``[]`` for blank text."""
    stripped = strip(text)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, WS + "+"))


def _may_be_number(token: Column) -> Column:
    # Between '9' and U+0660 no character is a decimal digit, so two comparisons of bytes
    # turn away nearly all words before the regex runs.
    return (token >= "0") & ((token < ":") | (token >= "\u0660"))


def is_number(token: Column, digit_limit: int = 6) -> Column:
    """Whole token is 1 to ``digit_limit`` decimal digits (any script)."""
    return (
        _may_be_number(token)
        & (F.length(token) <= digit_limit)
        & token.rlike(f"^\\p{{Nd}}{{1,{digit_limit}}}$")
    )


def is_decimal(token: Column) -> Column:
    """Whole token is decimal digits, of any length."""
    return _may_be_number(token) & token.rlike(r"^\p{Nd}+$")


@lru_cache(maxsize=1)
def _digit_tables() -> tuple[str, str]:
    digits = [
        c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"
    ]
    return "".join(digits), "".join(str(unicodedata.decimal(c)) for c in digits)


def to_int(token: Column) -> Column:
    """BIGINT value of a digit token, NULL if it is none; digits of any script."""
    source, target = _digit_tables()
    ascii_value = token.try_cast("bigint")
    return F.coalesce(ascii_value, F.translate(token, source, target).try_cast("bigint"))


LITERAL = r"(?:[A-Za-z0-9_-]|\\[^\w\s])+"
MOST_ALTERNATIVES = 100
# Further characters that fold to i, k and s.
FOLDED = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}
FOLDING = {**{ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{ord(f): c for c, fs in FOLDED.items() for f in fs}}


class Keywords:
    """Keywords to look for: ``(regex fragment, may have a plural s)`` pairs.

    Up to ``MOST_ALTERNATIVES`` of them are one regular expression. A longer list of literal fragments becomes
    two sets of folded forms, one of the keywords and one of their plurals, which a token is looked up in by
    hash, so its cost does not grow with the list.
    """

    def __init__(self, specs: Sequence[tuple[str, bool]]):
        self.specs = list(specs)
        self.literal = all(re.fullmatch(LITERAL, fragment) for fragment, _ in self.specs)
        self.listed = self.literal and len(self.specs) > MOST_ALTERNATIVES
        if self.listed:
            self._plain, self._plural = self._forms()
            return
        body = "|".join(f"({fragment}){'s?' if plural else ''}" for fragment, plural in self.specs)
        self.body = body
        self.pattern = f"(?iu)^(?:{body})$"
        groups = re.compile(body).groups
        self._stem = "".join(f"${g}" for g in range(1, groups + 1))
        self._first = self._first_characters()

    def _forms(self) -> tuple[set[str], set[str]]:
        """Folded forms that are keywords, and those that are a keyword with its s; the first keyword that
        a form belongs to decides."""
        stem: dict[str, bool] = {}
        for fragment, plural in self.specs:
            word = re.sub(r"\\(.)", r"\1", fragment).lower()
            stem.setdefault(word, True)
            if plural:
                stem.setdefault(word + "s", False)
        return {w for w, own in stem.items() if own}, {w for w, own in stem.items() if not own}

    def _first_characters(self) -> list[str] | None:
        """Characters a match can begin with, or None if a fragment is more than a literal."""
        if not self.literal:
            return None
        first: set[str] = set()
        for fragment, _ in self.specs:
            c = fragment.lstrip("\\")[0]
            first |= {c.lower(), c.upper()}
        return sorted(first | {f for c in first for f in FOLDED.get(c, "")})

    @staticmethod
    def _folded(token: Column) -> Column:
        letters = "".join(map(chr, range(ord("a"), ord("z") + 1)))
        others = "".join(f for c in FOLDED.values() for f in c)
        return F.translate(token, letters.upper() + others, letters + "".join(c * len(f) for c, f in FOLDED.items()))

    def found(self, token: Column) -> Column:
        """Whether the whole token is one of the keywords."""
        if self.listed:
            return _is_in(self._folded(token), self._plain | self._plural)
        found = token.rlike(self.pattern)
        if self._first is not None:
            found = F.substring(token, 1, 1).isin(self._first) & found
        return found

    def stem(self, token: Column) -> Column:
        """A keyword token in lower case and without the plural s."""
        if self.listed:
            plural = _is_in(self._folded(token), self._plural)
            return F.lower(F.when(plural, F.left(token, F.length(token) - 1)).otherwise(token))
        return F.lower(F.regexp_replace(token, self.pattern, self._stem))

    def may_match(self, token: str) -> bool:
        """False for most tokens that are no keyword, by their first character."""
        return self.listed or self._first is None or token[:1] in self._first

    def stem_of(self, token: str) -> str | None:
        """The same as ``match`` for one string."""
        if self.listed:
            form = token.translate(FOLDING)
            return None if form not in self._plain and form not in self._plural else (token[:-1] if form in self._plural else token).lower()
        found = re.fullmatch(self.body, token, re.IGNORECASE)
        return found and "".join(g or "" for g in found.groups()).lower()

    def match(self, token: Column) -> Column:
        """The stem, or NULL if the token is no keyword."""
        return F.when(self.found(token), self.stem(token))


def _is_in(token: Column, forms: set[str]) -> Column:
    """``token IN (forms)``, which the optimizer turns into a look-up by hash."""
    return token.isin(sorted(forms)) if forms else F.lit(False)


# The keywords counted by default.
DEFAULT_KEYWORDS = Keywords(
    [
        ("second", True),
        ("minute", True),
        ("hour", True),
        ("day", True),
        ("week", True),
        ("month", True),
        ("year", True),
        ("decade", True),
        ("plus", False),
        (r"\+", False),
        ("minus", False),
        ("-", False),
        ("times", False),
        (r"\*", False),
    ]
)
