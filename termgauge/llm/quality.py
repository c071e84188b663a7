"""Quality rules: counts of words, symbols and repetition, and a line labeller.

A linear-chain conditional random field marks every line that has a word as content or as
boilerplate. Its features are measured on the line; its weights and transitions are fitted by the
gradient of the likelihood on labelled texts, of which every line takes the label of its text. The
best sequence of marks is found by Viterbi decoding. A text stays if its base rules hold and at
least ``CONTENT_SHARE`` of its words stand in content lines.

Fitting takes at most ``PER_CLASS`` labelled texts of either label, those with the smallest hash,
of at most ``FIT_LINES`` lines, whole; both are parameters. All texts are judged, whole.

Defined results: words are runs without ASCII blanks; NULL, empty and blank texts have no words
and fail; repeated rows and ties have equal results; an empty table gives no rows; without
labelled texts of both kinds every line is content; other columns are ignored, whatever their
names. Ties between marks are content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgauge.llm import textbuf
from termgauge.llm.sample import labelled_texts

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
CONTENT_SHARE = 0.5
PER_CLASS = 300
FIT_LINES = 60
SYMBOLS = b"#*$%&|<>"
FEATURES = ("bias", "symbols", "capitals", "exclaimed", "repeated line", "repeated words", "digits", "short", "long words")

_symbol = np.zeros(256, np.int64)
_symbol[list(SYMBOLS)] = 1
_capital = np.zeros(256, np.int64)
_capital[65:91] = 1
_letter = np.zeros(256, np.int64)
_letter[65:91] = _letter[97:123] = _letter[128:] = 1
_digit = np.zeros(256, np.int64)
_digit[48:58] = 1
_mark = np.zeros(256, np.int64)
_mark[33] = 1
_start = np.ones(256, np.int64)  # first bytes of characters
_start[128:192] = 0


@dataclass
class Field:
    """A linear-chain field of two marks: 0 boilerplate, 1 content."""

    weights: np.ndarray  # of content against boilerplate
    moves: np.ndarray  # from mark to mark

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The best sequence of marks."""
        emit = (features @ self.weights).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        n = len(emit)
        back0, back1 = [0] * n, [0] * n
        a, b = 0.0, emit[0]
        for i in range(1, n):
            to0, from1to0, to1, from1to1 = a + m00, b + m10, a + m01, b + m11
            back0[i], a0 = (1, from1to0) if from1to0 >= to0 else (0, to0)
            back1[i], b = (1, from1to1 + emit[i]) if from1to1 >= to1 else (0, to1 + emit[i])
            a = a0
        marks = np.zeros(n, np.int8)
        mark = 1 if b >= a else 0
        for i in range(n - 1, -1, -1):
            marks[i] = mark
            mark = back1[i] if mark else back0[i]
        return marks


def _reach(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values)]
    return total[ends] - total[starts]


def measure(column: pa.Array) -> Iterator[tuple[int, dict, np.ndarray, np.ndarray]]:
    """Row, counts, and for its lines with a word: features and words."""
    for lo, hi, data, offsets in textbuf.chunks(column):
        n = hi - lo
        starts, ends, rows = textbuf.spans(data, offsets)
        hashes = textbuf.word_hashes(data, starts, ends)
        words = np.bincount(rows, minlength=n)
        inside = (~textbuf.GAP[data]) * _start[data]
        chars = _reach(inside, offsets[:-1], offsets[1:])
        symbols = _reach(_symbol[data], offsets[:-1], offsets[1:])

        first, found = textbuf.windows(hashes, rows, WINDOW)
        covered = np.zeros(len(rows) + 1, np.int64)
        if len(first):
            keys = textbuf.mix(found ^ textbuf.mix(rows[first].astype(np.uint64)))
            order = np.argsort(keys, kind="stable")
            same = keys[order][1:] == keys[order][:-1]
            often = np.r_[False, same] | np.r_[same, False]
            at = first[order[often]]
            covered += np.bincount(at, minlength=len(covered)) - np.bincount(at + WINDOW, minlength=len(covered))
        repeated = (np.cumsum(covered)[:-1] > 0).astype(np.int64)
        repeats = np.bincount(rows, weights=repeated, minlength=n).astype(np.int64)

        cut = np.flatnonzero(data == 10)
        begin = np.unique(np.r_[offsets[:-1], cut + 1])
        begin = begin[begin < len(data)]
        stop = np.minimum(np.r_[begin[1:], len(data)], len(data))
        stop = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10))
        word_lo, word_hi = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
        real = word_hi > word_lo
        begin, stop, word_lo, word_hi = begin[real], stop[real], word_lo[real], word_hi[real]
        line_row = np.searchsorted(offsets, begin, "right") - 1
        if len(begin):
            keys = textbuf.mix(textbuf.word_hashes(data, begin, stop, raw=True) ^ textbuf.mix(line_row.astype(np.uint64)))
            _, unique = np.unique(keys, return_index=True)
            again = np.ones(len(begin), np.int64)
            again[unique] = 0
        else:
            again = np.zeros(0, np.int64)
        line_words = word_hi - word_lo
        count = lambda table: _reach(table[data], begin, stop)
        letters = np.maximum(count(_letter), 1)
        x = np.column_stack(
            [
                np.ones(len(begin)),
                np.minimum(count(_symbol) / line_words, 3),
                count(_capital) / letters,
                np.minimum(count(_mark) / line_words, 2),
                again,
                _reach(repeated, word_lo, word_hi) / line_words,
                count(_digit) / np.maximum(stop - begin, 1),
                line_words < 4,
                letters / line_words > 14,
            ]
        ).astype(float)
        dup = np.bincount(line_row, weights=again, minlength=n).astype(np.int64)
        edges = np.searchsorted(line_row, np.arange(n + 1))
        for row in range(n):
            own = slice(edges[row], edges[row + 1])
            counts = {
                "n_words": int(words[row]),
                "word_chars": int(chars[row]),
                "n_symbols": int(symbols[row]),
                "n_dup_lines": int(dup[row]),
                "n_repeat_words": int(repeats[row]),
            }
            yield lo + row, counts, x[own], line_words[own]


# ------------------------------------------------------------------ fitting


def _likelihood(field: Field, lines: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood of one sequence, by forward and backward sums."""
    emit = lines @ field.weights
    n = len(emit)
    own = np.zeros((n, 2))
    own[:, 1] = emit
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = own[0]
    for i in range(1, n):
        ahead[i] = np.logaddexp(ahead[i - 1, 0] + field.moves[0], ahead[i - 1, 1] + field.moves[1]) + own[i]
    for i in range(n - 2, -1, -1):
        onward = own[i + 1] + behind[i + 1]
        behind[i] = np.logaddexp(field.moves[:, 0] + onward[0], field.moves[:, 1] + onward[1])
    total = np.logaddexp(*ahead[-1])
    chance = np.exp(ahead[:, 1] + behind[:, 1] - total)
    by_weight = lines.T @ (marks - chance)
    by_move = np.zeros((2, 2))
    if n > 1:
        pair = ahead[:-1, :, None] + field.moves[None] + (own + behind)[1:, None, :] - total
        by_move -= np.exp(pair).sum(0)
        np.add.at(by_move, (marks[:-1], marks[1:]), 1)
    return by_weight, by_move


def fit(lines: list[np.ndarray], labels: list[int], rounds: int = 40, rate: float = 0.5, keep: float = 1e-3, loose: float = 0.3) -> Field:
    """Weights and moves by ascent with steps scaled to the gradients so far.

    A text's lines all have its label, so unchecked moves would never change marks; ``loose`` is
    the penalty that keeps them small enough for a line to stand out from its neighbours.
    """
    width = len(FEATURES)
    field = Field(np.zeros(width), np.zeros((2, 2)))
    if len(set(labels)) < 2:
        field.weights[0] = 1.0
        return field
    share = {c: labels.count(c) for c in set(labels)}
    seen_w, seen_m = np.full(width, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        by_w, by_m = np.zeros(width), np.zeros((2, 2))
        for x, label in zip(lines, labels):
            w, m = _likelihood(field, x, np.full(len(x), label))
            by_w += w / (share[label] * len(x))
            by_m += m / (share[label] * len(x))
        by_w -= keep * field.weights
        by_m -= loose * field.moves
        seen_w += by_w**2
        seen_m += by_m**2
        field.weights += rate * by_w / np.sqrt(seen_w)
        field.moves += rate * by_m / np.sqrt(seen_m)
    return field


def fit_field(
    documents: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    per_class: int = PER_CLASS,
    key: str = "doc_id",
    text: str = "text",
    fit_lines: int = FIT_LINES,
) -> Field:
    """A field fitted on at most ``per_class`` texts of either label, of at most ``fit_lines`` lines."""
    body = F.col(f"`{text}`")
    short = documents.where(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) < fit_lines)
    chosen = labelled_texts(short, labels, label, {0: per_class, 1: per_class}, key, text)

    def features(batches):
        for batch in batches:
            labels, ns, flat = [], [], []
            for row, _, x, _ in measure(batch.column(2)):
                if len(x):
                    labels.append(batch.column(0)[row].as_py())
                    ns.append(batch.column(1)[row].as_py())
                    flat.append(x.ravel().tolist())
            columns = [pa.array(labels, pa.int32()), pa.array(ns, pa.int32()), pa.array(flat, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "n", "x"])

    chosen = chosen.select("label", "n", "text")
    sample = sorted(chosen.mapInArrow(features, "label int, n int, x array<double>").collect(), key=lambda r: (r.label, r.n))
    lines = [np.array(r.x).reshape(-1, len(FEATURES)) for r in sample]
    return fit(lines, [r.label for r in sample])


# ------------------------------------------------------------------ judging

RESULT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, content_share double"
)


def judge(
    documents: DataFrame, field: Field, key: str = "doc_id", text: str = "text", share: float = CONTENT_SHARE
) -> DataFrame:
    """doc_id, the counts, base_failed, kept, content_share for every row."""
    rows = documents.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        for batch in batches:
            out = []
            for _, c, x, line_words in measure(batch.column(1)):
                failed = c["n_words"] < MIN_WORDS or 100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"]
                content = 0.0
                if len(x):
                    content = float((field.decode(x) * line_words).sum() / line_words.sum())
                out.append((*c.values(), failed, not failed and content >= share, content))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]
            names = [x.split()[0] for x in RESULT.split(", ")]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id bigint, {RESULT}")
