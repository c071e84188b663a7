"""Toxicity by a support vector machine on a gapped subsequence kernel with Nyström landmarks.

The kernel of two strings sums, over their common subsequences of ``P`` letters, a decay for every
letter that either spans, so ``id-iot``, ``idxiot``, ``id*ot`` and an insult with any ending are close
to the plain one; it is normalised. Strings are the words of a text, with letters of their own for start
and end; a word of more than ``SPAN`` letters counts by all its runs of ``SPAN`` letters, so no match of
that width is lost. Runs of single letters are read as one word, and words lose everything that is no
letter. Strings are compared with landmarks, whose own kernel matrix turns the values into Nyström
features, on which a linear machine finds weights and bias.

The machine is trained on labelled texts: a text's value is the highest of its strings' (the empty
string, whose value is the bias, included), and the hinge loss is that of the text's label. As the
highest string depends on the machine, the two alternate: every toxic text stands for its highest
string, every clean text for those strings that came high in any round. Virtual examples, as is usual
for invariances, are landmarks with letters inserted, around, and one missing, while the machine holds
the landmark itself for toxic. Landmarks are runs of letters that toxic texts have far more often
(``find_cores``), the most frequent word around each, strings of clean texts that came high, and
``OTHERS`` clean ones: they span the features, and labels decide the weights.

A machine that is linear in kernel values is linear in subsequences too, so the weights of all
landmarks are summed into one table by subsequence, and a string is scored by one pass over its own
subsequences, whatever the number of landmarks: the same values as landmark by landmark.

Fitting takes at most ``per_class`` toxic and twice as many clean labelled texts, those with the
smallest hash among texts of at most ``fit_bytes`` bytes, whole; both are parameters. All texts are
scored, whole, very long ones in parts of words.

Defined results: NULL and empty texts and texts without letters score 0; equal texts have equal
scores; repeated rows stay; an empty table gives no rows; without toxic or without clean labelled
texts every score is 0; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgauge.llm import textbuf
from termgauge.llm.sample import labelled_texts

P, DECAY = 4, 0.6
PER_CLASS = 600
FIT_BYTES = 1 << 16
LEAST = 5  # texts that a core is found in
OTHERS, NEAR = 6, 40  # landmarks of clean texts
ROUNDS = 6
CORE_LETTERS = range(4, 9)
SPAN = 10
KEPT = 1 << 20
THRESHOLD = 0.3

_scorers: dict[bytes, Scorer] = {}

_not_letters = re.compile(r"[\W\d_]+")
_no_letter = re.compile(r"[^\w\n]+|[\d_]+")  # words hold no line feeds


def letters(word: str) -> str:
    return _not_letters.sub("", word.lower())


def words_of(text: str) -> list[str]:
    """Words without other characters; runs of three or more single letters are one word."""
    out, singles = [], []
    for part in [*text.split(), ""]:
        own = letters(part)
        if len(own) == 1:
            singles.append(own)
            continue
        if len(singles) > 2:
            out.append("".join(singles))
        singles = []
        if own:
            out.append(own)
    return out


def marked(word: str) -> str:
    """The word with marks of its start and end, which are letters to the kernel."""
    return f"^{word}$"


def pieces(word: str) -> list[str]:
    """All runs of ``SPAN`` letters; a shorter word is one."""
    if len(word) <= SPAN:
        return [word]
    return [word[at : at + SPAN] for at in range(len(word) - SPAN + 1)]


class Landmarks:
    """Kernel values of strings with a fixed list of short strings."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        self.width = max(map(len, strings))
        self.codes = self._codes(strings, self.width)
        self.alphabet = np.unique(self.codes[self.codes != 0])
        # Bit j of places[letter, landmark]: the letter stands there; the last letter is any other.
        self.places = np.zeros((len(self.alphabet) + 1, len(strings)), np.uint64)
        for j in range(self.width):
            at = np.flatnonzero(self.codes[:, j])
            self.places[np.searchsorted(self.alphabet, self.codes[at, j]), at] |= np.uint64(1 << j)
        self.sizes = np.array([len(s) for s in strings])
        self.full = (np.uint64(1) << self.sizes.astype(np.uint64)) - np.uint64(1)
        self.codes[self.codes == 0] = 0xFFFFFFFF
        self.squares = np.maximum(self._squares(strings), np.float32(1e-9))

    @staticmethod
    def _codes(strings: list[str], width: int) -> np.ndarray:
        joined = "".join(s.ljust(width, "\0") for s in strings)
        return np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(len(strings), width).copy()

    def _common(self, codes: np.ndarray) -> np.ndarray:
        """Letters of the longest common subsequence of every string and landmark."""
        place = np.searchsorted(self.alphabet, codes)
        known = self.alphabet[np.minimum(place, len(self.alphabet) - 1)] == codes
        place = np.where(known, place, len(self.alphabet))
        left = np.broadcast_to(self.full, (len(codes), len(self.sizes))).copy()
        for j in range(codes.shape[1]):
            met = left & self.places[place[:, j]]
            left = (left + met) | (left - met)
        return self.sizes - np.bitwise_count(left & self.full)

    def whole(self, strings: list[str]) -> np.ndarray:
        """A row for each string; only pairs without a common subsequence of ``P`` letters, whose kernel is 0, are left out."""
        out = np.zeros((len(strings), len(self.strings)), np.float32)
        order = np.argsort([len(s) for s in strings], kind="stable")
        for lo in range(0, len(order), 4000):
            own = order[lo : lo + 4000]
            part = [strings[i] for i in own]
            codes = self._codes(part, max(map(len, part)))
            rows, columns = np.nonzero(self._common(codes) >= P)
            for at in range(0, len(rows), 20_000):
                r, c = rows[at : at + 20_000], columns[at : at + 20_000]
                out[own[r], c] = self._pairs(codes[r, : len(part[r.max()])], self.codes[c])
        return out

    def features(self, strings: list[str]) -> np.ndarray:
        """``whole``, normalised (the kernel of equal strings is 1); then the share of each landmark's own."""
        raw = self.whole(strings)
        own = np.ones(len(strings), np.float32)
        met = np.flatnonzero(raw.any(1))
        own[met] = self.squares_of([strings[i] for i in met])
        return np.hstack([raw / np.sqrt(own[:, None] * self.squares), raw / self.squares])

    def squares_of(self, strings: list[str]) -> np.ndarray:
        """The kernel of each string with itself, for any number of strings."""
        out = np.zeros(len(strings), np.float32)
        order = np.argsort([len(s) for s in strings], kind="stable")
        for lo in range(0, len(order), 4000):
            own = order[lo : lo + 4000]
            out[own] = self._squares([strings[i] for i in own])
        return out

    def _squares(self, strings: list[str]) -> np.ndarray:
        """The kernel of each string with itself."""
        s = self._codes(strings, max(map(len, strings)))
        return self._pairs(s, np.where(s == 0, np.uint32(0xFFFFFFFF), s))

    @staticmethod
    def _pairs(s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The kernel of row i of ``s`` with row i of ``t``."""
        s, t = np.ascontiguousarray(s.T), np.ascontiguousarray(t.T)
        n, m = s.shape[1], t.shape[0]
        square, decay = np.float32(DECAY**2), np.float32(DECAY)
        # inner[i][j]: weighted common subsequences of i letters of what was read and t[:j]
        inner = [np.ones((m + 1, n), np.float32), *[np.zeros((m + 1, n), np.float32) for _ in range(P - 1)]]
        total = np.zeros(n, np.float32)
        for x in s:
            match = (x[None] == t) * square
            total += (match * inner[P - 1][:m]).sum(0)
            for i in range(P - 1, 0, -1):
                fresh = match * inner[i - 1][:m]
                run = np.zeros(n, np.float32)
                inner[i] *= decay
                for j in range(m):
                    run = run * decay + fresh[j]
                    inner[i][j + 1] += run
        return total


class Subsequences:
    """The weights of all landmarks, summed for each subsequence of ``P`` (four) letters.

    The first and the last two letters of a subsequence have numbers, 0 for pairs that no landmark has.
    The real part of an entry is of the normalised kernel, the imaginary one of the other.
    """

    def __init__(self, landmarks: Landmarks, weights: np.ndarray):
        self.alphabet, self.squares_of = landmarks.alphabet, landmarks.squares_of
        self.base = len(self.alphabet) + 1
        total: dict[tuple[int, int], complex] = {}
        squares = landmarks.squares.astype(float)
        normal, plain = weights.reshape(2, -1).astype(float)
        for string, weight in zip(landmarks.strings, (normal / np.sqrt(squares) + 1j * plain / squares).tolist()):
            x = self._letters(Landmarks._codes([string], len(string)))[0].tolist()
            for i, j, k, m in combinations(range(len(x)), P):
                pair = x[i] * self.base + x[j], x[k] * self.base + x[m]
                total[pair] = total.get(pair, 0.0) + weight * DECAY ** (m - i + 1)
        heads, tails = sorted({h for h, _ in total}), sorted({t for _, t in total})
        self.head, self.tail = np.zeros(self.base**2, np.int32), np.zeros(self.base**2, np.int32)
        width = len(tails) + 1
        self.head[heads] = np.arange(1, len(heads) + 1) * width
        self.tail[tails] = np.arange(1, len(tails) + 1)
        self.table = np.zeros((len(heads) + 1) * width, np.complex64)
        for (h, t), value in total.items():
            self.table[self.head[h] + self.tail[t]] = value

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of letters, 0 for those that no landmark has."""
        place = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[place] == codes, place + 1, 0)

    def sums(self, strings: list[str]) -> np.ndarray:
        """The weighted kernel values of each string (of ``SPAN`` letters at most), if above 0."""
        out = np.zeros(len(strings), np.float32)
        sizes = np.array([len(s) for s in strings])
        for size in range(P, SPAN + 1):
            pairs = {pair: n for n, pair in enumerate(combinations(range(size), 2))}
            places = list(combinations(range(size), P))
            left, right = np.array(list(pairs)).T
            # A string of different letters has the least kernel with itself.
            least = sum(DECAY ** (2 * (p[-1] - p[0] + 1)) for p in places) ** 0.5
            own = np.flatnonzero(sizes == size)
            for lo in range(0, len(own), 4000):
                part = own[lo : lo + 4000]
                some = [strings[i] for i in part]
                x = np.ascontiguousarray(self._letters(Landmarks._codes(some, size)).T)
                pair = x[left] * self.base + x[right]
                head, tail = self.head[pair], self.tail[pair]
                total = np.zeros(len(part), np.complex64)
                for p in places:
                    total += self.table[head[pairs[p[:2]]] + tail[pairs[p[2:]]]] * np.float32(DECAY ** (p[-1] - p[0] + 1))
                value = np.zeros(len(part), np.float32)
                met = np.flatnonzero(np.maximum(total.real, 0) / least + total.imag > 0)
                if len(met):
                    square = np.sqrt(self.squares_of([some[i] for i in met]))
                    value[met] = np.maximum(total.real[met] / square + total.imag[met], 0)
                out[part] = value
        return out


@dataclass
class Model:
    landmarks: Landmarks | None
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_table"}  # built anew by each process

    def values(self, strings: list[str]) -> np.ndarray:
        """The machine's value of each string, the empty string's at least."""
        if "_table" not in self.__dict__:
            self._table = Subsequences(self.landmarks, self.weights)
        return self._table.sums(strings).astype(float) + self.bias

    def chance(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -30, 30)))


# ------------------------------------------------------------------ fitting


def find_cores(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> list[str]:
    """Runs of letters that toxic texts have far more often, strongest first, none within words of another.

    The counters hold the number of texts that have a word.
    """
    least = LEAST

    def counts(words: Counter, sizes, only=None) -> Counter:
        total = Counter()
        for word, n in words.items():
            for size in sizes:
                own = {word[i : i + size] for i in range(len(word) - size + 1)}
                for run in own if only is None else own & only:
                    total[run] += n
        return total

    # Words with a short run that is more frequent in toxic texts; then all runs of those words.
    short = min(CORE_LETTERS)
    first = {run: n for run, n in counts(toxic, [short]).items() if n >= least}
    usual = counts(clean, [short], first.keys())
    first = {run for run, n in first.items() if n / n_toxic > 5 * (usual[run] + 0.5) / n_clean}
    some = Counter({w: n for w, n in toxic.items() if any(w[i : i + short] in first for i in range(len(w) - short + 1))})
    runs = {run: n for run, n in counts(some, CORE_LETTERS).items() if n >= least}
    others = counts(clean, CORE_LETTERS, runs.keys())
    able = {}
    for run, n in runs.items():
        if n / n_toxic > 25 * others[run] / n_clean:
            able[run] = n
    left, cores = dict(toxic), []
    bare = {run: run.strip("^$") for run in able}
    for run in sorted(able, key=lambda r: (-able[r] * (len(bare[r]) - 2), len(r), r)):
        # The longest run around it that is nearly as frequent; marks only where they are needed.
        ends = len(run) - len(bare[run])
        around = (r for r in able if run in r and len(r) - len(bare[r]) == ends and able[r] >= 0.9 * able[run])
        run = max(around, key=lambda r: (len(r), able[r], r))
        covered = [w for w in left if run in w]
        if sum(left[w] for w in covered) >= least:
            cores.append(run)
            for w in covered:
                del left[w]
    return cores


def inserted(word: str, n: int, pick: np.random.Generator) -> str:
    """The word with ``n`` letters put in at different places."""
    places = set(pick.choice(len(word) - 1, min(n, len(word) - 1), replace=False).tolist())
    return "".join(c + (chr(97 + int(pick.integers(26))) if i in places else "") for i, c in enumerate(word))


def around(word: str, pick: np.random.Generator) -> list[str]:
    """The word with letters before and after it, where no mark says that there are none."""
    out = []
    for n in (2, 5, 8):
        head, tail = ("".join(chr(97 + int(x)) for x in pick.integers(26, size=n)) for _ in range(2))
        out.append(("" if word[0] == "^" else head) + word + ("" if word[-1] == "$" else tail))
    return out


def lacking(word: str) -> list[str]:
    """The word without one of its letters, where ``P`` letters or marks are left."""
    return sorted({word[:i] + word[i + 1 :] for i in range(1, len(word) - 1)}) if len(word) > P else []


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 30.0) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-3
    for _ in range(50):
        inside = y * (x @ w) < 1
        own = x[inside] * (cost * weight[inside])[:, None]
        new = np.linalg.solve(keep + own.T @ x[inside], own.T @ y[inside])
        if np.allclose(new, w, atol=1e-8):
            break
        w = w + (new - w) * 0.8
    return w[:-1], float(w[-1])


def logistic(value: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with labels smoothed towards each other."""
    up, down = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    w, x = np.zeros(2), np.column_stack([value, np.ones(len(value))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p) - 1e-6 * w)
        w = w + step * min(1.0, 2 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def solve(landmarks: Landmarks, strings: list[str], y: np.ndarray, weight: np.ndarray, known: dict[str, np.ndarray]) -> Model:
    """Machine on the Nyström features of strings; its weights are those of kernel values.

    ``known`` holds the kernel values of strings met in earlier rounds with the same landmarks.
    """
    fresh = sorted({s for s in strings if s not in known})
    known.update(zip(fresh, landmarks.features(fresh) if fresh else []))
    n = len(landmarks.strings)
    gram = landmarks.features(landmarks.strings).astype(float)[:, :n]
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    good = value > 1e-6 * value.max()
    nystrom = vector[:, good] / np.sqrt(value[good])
    features = np.array([known[s] for s in strings], float)
    features = np.hstack([features[:, :n] @ nystrom, features[:, n:]])
    scale = np.abs(features).max(0) + 1e-9
    w, bias = machine(features / scale, y, weight)
    w = w / scale
    weights = np.r_[nystrom @ w[: nystrom.shape[1]], w[nystrom.shape[1] :]]
    return Model(landmarks, weights.astype(np.float32), bias)


class Bags:
    """Strings of texts, each distinct string once."""

    def __init__(self, bags: list[set[str]]):
        self.kinds = sorted(set().union(*bags)) if bags else []
        at = {k: i for i, k in enumerate(self.kinds)}
        self.owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        self.kind = np.array([at[k] for b in bags for k in sorted(b)], np.int64)

    def highest(self, value: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Text and string of the ``most`` highest strings of each text, highest first."""
        order = np.lexsort([self.kind, -value[self.kind], self.owner])
        owner = self.owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        chosen = order[place < most]
        return self.owner[chosen], self.kind[chosen]


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """A model from labelled texts; copies of a text with the same label count once."""
    distinct = sorted({(t, int(c)) for t, c in zip(texts, labels)})
    texts, labels = [t for t, _ in distinct], [c for _, c in distinct]
    pick = np.random.default_rng(seed)
    label = np.array(labels, int)
    words = [{marked(w) for w in words_of(t)} for t in texts]
    toxic, clean = Counter(), Counter()
    for bag, is_toxic in zip(words, labels):
        (toxic if is_toxic else clean).update(bag)
    n_toxic, n_clean = int(label.sum()), len(label) - int(label.sum())
    cores = find_cores(toxic, clean, n_toxic, n_clean) if n_toxic and n_clean else []
    if not cores:
        return Model(None, np.zeros(0), 0.0)
    bags = Bags([{p for w in bag for p in pieces(w)} for bag in words])
    kinds = bags.kinds
    usual = [max((w for w in toxic if c in w), key=lambda w: (toxic[w], w)) for c in cores]
    usual = [w for c, w in zip(cores, usual) if w != c and len(w) <= SPAN]
    in_clean, times = np.unique(bags.kind[label[bags.owner] == 0], return_counts=True)
    times_clean = Counter({kinds[i]: n for i, n in zip(in_clean.tolist(), times.tolist())})
    others = [kinds[i] for i in pick.permutation(in_clean) if len(kinds[i]) >= P][:3000]
    own = sorted({*cores, *usual})
    marks = Landmarks(sorted({*own, *others[:OTHERS]}))
    # First round: toxic texts stand for their strings with a core, clean ones for any.
    holds = re.compile("|".join(map(re.escape, cores))).search
    value = np.array([1.0 if holds(k) else 0.0 for k in kinds])
    high: set[int] = set()  # strings of clean texts that came high in any round
    witness, model, known = None, None, {}
    variants = {w: around(w, pick) + around(w, pick) + [inserted(w, n, pick) for n in (1, 1, 1, 1, 1, 1, 2, 2)] for w in own}
    for turn in range(ROUNDS):
        owner, kind = bags.highest(value, 3)
        low = label[owner] == 0
        high |= set(kind[low].tolist())
        best, first = np.unique(owner, return_index=True)
        stands = label[best] == 1
        if turn == 0:
            stands &= value[kind[first]] > 0
        now = kind[first][stands]
        if turn == 2:  # strings that clean texts came highest with are landmarks from here on
            near = sorted(high, key=lambda i: (-value[i], i))[:NEAR]
            marks, known = Landmarks(sorted({*marks.strings, *(kinds[i] for i in near)})), {}
        elif witness is not None and np.array_equal(now, witness):
            break
        witness = now
        held = own if model is None else [w for w, v in zip(own, model.values(own)) if v > model.bias / 2]
        added = [p for w in held for v in variants[w] for p in pieces(v) if len(v) <= SPAN or holds(p)]
        masked = sorted({v for w in held for v in lacking(w) if v not in clean})
        negative = sorted({kinds[i] for i in high} | set(others))
        strings = [kinds[i] for i in witness] + added + masked + negative
        sizes = (len(witness), len(added), len(masked), len(negative))
        y = np.repeat([1.0, 1.0, 1.0, -1.0], sizes)
        weight = np.repeat([share / max(1, n) for share, n in zip((1.0, 1.0, 0.3, 6.0), sizes)], sizes) * len(strings)
        # Texts that stand for the same string share the root of their number, or rare strings would not count.
        _, at, times = np.unique(witness, return_inverse=True, return_counts=True)
        shared = 1 / np.sqrt(times[at])
        weight[: len(witness)] *= shared / max(shared.mean(), 1e-9)
        # So do clean texts: a string counts by the root of the number of clean texts that hold it.
        often = np.sqrt([times_clean[k] for k in negative])
        weight[-len(negative) :] *= often / often.mean()
        model = solve(marks, strings, y, weight, known)
        value = model.values(kinds)
    best = np.full(len(label), model.bias)
    np.maximum.at(best, bags.owner, value[bags.kind])
    model.slope, model.shift = logistic(best, label)
    return model


def fit(
    documents: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    per_class: int = PER_CLASS,
    key: str = "doc_id",
    text: str = "text",
    fit_bytes: int = FIT_BYTES,
) -> Model:
    """A model of at most ``per_class`` toxic and twice as many clean labelled texts of at most ``fit_bytes`` bytes."""
    short = documents.where(F.octet_length(f"`{text}`") <= fit_bytes)
    chosen = labelled_texts(short, labels, label, {0: 2 * per_class, 1: per_class}, key, text)
    sample = sorted((r.label, r.n, r.text) for r in chosen.select("label", "n", "text").collect())
    return train([t for _, _, t in sample], [c for c, _, _ in sample])


# ------------------------------------------------------------------ scoring


class Scorer:
    """Highest value of the words of texts; values of words that were met are kept, ``KEPT`` of them."""

    def __init__(self, model: Model):
        self.model = model
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def best(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), -np.inf)
        for lo, _, data, offsets in textbuf.chunks(column, 1 << 20):
            starts, ends, rows = textbuf.spans(data, offsets)
            if not len(starts):
                continue
            hashes = textbuf.word_hashes(data, starts, ends, lower=True)
            keys, first, at = np.unique(hashes, return_index=True, return_inverse=True)
            np.maximum.at(out, lo + rows, self._of(keys, first, data, starts, ends)[at])
            self._spelled(out, lo, data, starts, ends, rows)
        return out

    def _of(self, keys, first, data, starts, ends) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        values = np.full(len(keys), -np.inf)
        values[known] = self.values[place[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            raw = data.tobytes()
            values[fresh] = self._score([raw[starts[i] : ends[i]].decode() for i in first[fresh].tolist()])
            if len(self.keys) + len(fresh) > KEPT:
                self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)
            merged = np.concatenate([self.keys, keys[fresh]])
            order = np.argsort(merged, kind="stable")
            self.keys, self.values = merged[order], np.concatenate([self.values, values[fresh]])[order]
        return values

    def _score(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), -np.inf)
        parts, owner = [], []
        for i, own in enumerate(_no_letter.sub("", "\n".join(words).lower()).split("\n")):
            if own:
                found = pieces(marked(own))
                parts += found
                owner += [i] * len(found)
        if parts:
            np.maximum.at(out, owner, self.model.values(parts))
        return out

    def _spelled(self, out, lo, data, starts, ends, rows) -> None:
        """Insults spelled out with blanks between the letters."""
        single = ends - starts <= 2
        run = np.flatnonzero(single[2:] & single[1:-1] & single[:-2] & (rows[2:] == rows[:-2]))
        for own in np.split(run, np.flatnonzero(np.diff(run) > 1) + 1):
            if len(own):
                a, b = own[0], own[-1] + 3
                row = rows[a]
                b = a + int((rows[a:b] == row).sum())
                text = bytes(data[starts[a] : ends[b - 1]]).decode()
                found = [w for w in words_of(text) if len(w) > 2]
                if found:
                    out[lo + row] = max(out[lo + row], self._score(found).max())


def score(documents: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with score and predicted."""
    rows = documents.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    schema = documents.select(*[F.col(f"`{c}`") for c in keep]).withColumns(
        {"score": F.lit(0.0), "predicted": F.lit(0)}
    ).schema

    def run(batches):
        mark = model.weights.tobytes() + "".join(model.landmarks.strings if model.landmarks else []).encode()
        if mark not in _scorers:  # values are kept from task to task of a worker
            _scorers.clear()
            _scorers[mark] = Scorer(model)
        scorer = _scorers[mark]
        for batch in batches:
            value = np.zeros(batch.num_rows)
            if model.landmarks is not None:
                best = scorer.best(batch.column(0))
                met = np.isfinite(best)
                value[met] = model.chance(best[met])
            result = [pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *result], [*keep, "score", "predicted"])

    return rows.mapInArrow(run, schema)
