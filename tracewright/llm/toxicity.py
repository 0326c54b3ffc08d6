"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words sums their common subsequences of ``LENGTH`` characters, each discounted by
``GAP`` for every character it spans, so that inserted or missing characters weaken a match but do not
undo it.  Landmarks are the words of the labelled sentences that speak clearest for toxicity.  A word is mapped
through its kernels with the landmarks and the inverse root of the landmarks' own kernel matrix (the Nystroem map), and
a sentence is the largest value of its words in each direction of that map, or 0.  A linear machine is trained on labelled
texts as bags of sentences: a text is as toxic as its most toxic sentence, and that sentence is the one trained on.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes
from .sampling import PER_CLASS, fitted, labelled, remainder

#: Characters of a subsequence, discount, power of the normalised kernel (a power of a kernel is one), most landmarks, and letters that a landmark has at least.
LENGTH, GAP, POWER, LANDMARKS, SHORTEST = 3, 0.7, 2, 32, 4
#: Words above this many letters are looked at in pieces that overlap by half.
PIECE = 32
EPOCHS, REGULAR, SEED = 60, 1e-3, 3
#: Subsequences looked up and words compared with themselves in one pass, entries of a table of them, and words whose map a task remembers.
TRIPLES, PASS, TABLE, KNOWN = 1 << 17, 1 << 10, 1 << 22, 1 << 18
#: Digits and signs that stand for letters.
_FROM, _TO = "013457@$!", "oieastasi"
_ASCII = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _FROM.encode(), b"abcdefghijklmnopqrstuvwxyz" + _TO.encode())
_OTHER = bytes(b for b in range(256) if b > 127 or not bytes([b]).translate(_ASCII).isalpha())
_EDGE = ".,;:!?\"'()[]"
_SENTENCE_MARK, _TEXT_MARK = "\0", "\1"
_SPELT = re.compile(r"(?:^|\s)\S{1,2}(?:\s+\S{1,2}){3,}(?=\s|$)")
_SENTENCE = re.compile(r"[.!?。！？]+\s+|\n+")


class Machine(NamedTuple):
    landmarks: list[str]
    root: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float
    shift: float


def kernel(a: np.ndarray, b: np.ndarray, length: int = LENGTH, gap: float = GAP) -> np.ndarray:
    """Subsequence kernel of each pair of rows; 0 ends a row's text (it matches nothing)."""
    n, la, lb = len(a), a.shape[1], b.shape[1]
    same = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] > 0)
    inner = np.ones((n, la + 1, lb + 1))
    total = np.zeros(n)
    for k in range(length):
        # inner[i, j]: subsequences of k characters in the first i and j, discounted to the ends.
        hit = same * inner[:, :-1, :-1] * gap**2
        if k == length - 1:
            total = hit.sum(axis=(1, 2))
            break
        outer = np.zeros((n, la + 1, lb + 1))
        for j in range(1, lb + 1):
            outer[:, 1:, j] = gap * outer[:, 1:, j - 1] + hit[:, :, j - 1]
        for i in range(1, la + 1):
            outer[:, i] += gap * outer[:, i - 1]
        inner = outer
    return total


def pad(words: list[str]) -> np.ndarray:
    """Code points of each word, filled up with zeros."""
    width = max(map(len, words), default=1)
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), width)


def subsequences(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of LENGTH characters in a word, and their discounts."""
    at = np.array(list(combinations(range(width), LENGTH)), dtype=np.int64).reshape(-1, LENGTH)
    return at, GAP ** (at[:, -1] - at[:, 0] + 1.0)


def _codes(letters: np.ndarray, at: np.ndarray, base: int) -> np.ndarray:
    """One number for each subsequence of each row of letters (numbers under ``base``)."""
    return sum(letters[:, at[:, k]] * base**k for k in range(LENGTH))


def _own(rows: np.ndarray) -> np.ndarray:
    """Kernel of each row with itself."""
    return np.concatenate([kernel(rows[i : i + PASS], rows[i : i + PASS]) for i in range(0, len(rows), PASS)])


def similarities(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel, to its power, of each word with each landmark; 0 for words of fewer than LENGTH characters.

    The kernels come from the landmarks' subsequences, which are looked up in each word.
    """
    out = np.zeros((len(words), len(landmarks)))
    if not words or not landmarks:
        return out
    rows, marks = pad(words), pad(landmarks)
    used = np.unique(marks[marks > 0])
    base = len(used) + 1

    def letters(table: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(used, table), len(used) - 1)
        return np.where(used[at] == table, at + 1, 0).astype(np.int64)

    keys, weights = [], []
    for mark in landmarks:
        at, w = subsequences(len(mark))
        key, place = np.unique(_codes(letters(pad([mark])), at, base)[0], return_inverse=True)
        keys.append(key)
        weights.append(np.bincount(place, w, len(key)) if len(key) else w)
    known = np.unique(np.concatenate(keys))
    if not len(known):
        return out
    value = np.zeros((len(known), len(landmarks)))
    for m, (key, w) in enumerate(zip(keys, weights)):
        value[np.searchsorted(known, key), m] = w
    if base**LENGTH <= TABLE:
        row_of = np.full(base**LENGTH, -1, dtype=np.int32)
        row_of[known] = np.arange(len(known), dtype=np.int32)
        look_up = lambda codes: row_of[codes]
    else:

        def look_up(codes: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            return np.where(known[at] == codes, at, -1)

    ref = np.maximum((value * value).sum(axis=0), 1e-12)
    lengths = (rows > 0).sum(axis=1)
    own = np.ones(len(words))
    for n in np.unique(lengths[lengths >= LENGTH]):
        at, w = subsequences(int(n))
        group = np.flatnonzero(lengths == n)
        step = max(1, TRIPLES // len(at))
        for i in range(0, len(group), step):
            some = group[i : i + step]
            found = look_up(_codes(letters(rows[some][:, :n]), at, base))
            word, triple = np.nonzero(found >= 0)
            if len(word):
                first = np.flatnonzero(np.diff(word, prepend=-1))
                out[some[word[first]]] = np.add.reduceat(value[found[word, triple]] * w[triple, None], first, axis=0)
                hit = np.unique(word)
                own[some[hit]] = _own(rows[some[hit]][:, :n])
    return (out / np.sqrt(np.maximum(own[:, None] * ref, 1e-12))) ** POWER


class _Letters(dict):
    """Letters of any script and their marks stay, stand-ins turn to letters, everything else goes; filled as characters come."""

    def __missing__(self, point: int) -> int | None:
        c = chr(point)
        self[point] = ord(_TO[_FROM.index(c)]) if c in _FROM else point if c.isalpha() or unicodedata.category(c)[0] == "M" else None
        return self[point]


_KEPT = _Letters()


def clean(word: str) -> str:
    """A word with its letters only (of any script, with their marks), in lower case; signs between letters go, common stand-ins turn to letters."""
    word = word.strip(_EDGE)
    if word.isascii():
        return word.encode().translate(_ASCII, _OTHER).decode()
    return word.lower().translate(_KEPT)


def pieces(word: str) -> list[str]:
    """A cleaned word, or overlapping pieces of a long one; nothing for one without any subsequence."""
    if len(word) < LENGTH:
        return []
    return [word] if len(word) <= PIECE else [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


def spelt(text: str) -> list[str]:
    """Words spelt out: runs of ones and twos of characters, as a whole, and the ones among them that stand together."""
    found = []
    for run in _SPELT.findall(text):
        letters = [clean(x) for x in run.split()]
        found += ["".join(letters), *("".join(group) for single, group in groupby(letters, lambda x: len(x) < 2) if single)]
    return [w for w in dict.fromkeys(found) if len(w) >= SHORTEST]


class WordMap:
    """The Nystroem map of words, remembered for those that come again.  Rows 0 to 2 are zero: marks of a sentence and of a text, and words without any subsequence."""

    def __init__(self, landmarks: list[str], root: np.ndarray):
        self.landmarks, self.root = landmarks, root
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {_SENTENCE_MARK: 0, _TEXT_MARK: 1}
        self.cleaned: dict[str, int] = {}
        self.table = np.zeros((3, self.root.shape[1]), dtype=np.float32)

    def learn(self, words: set[str]) -> None:
        """Take in words of a batch; a batch is small, so the table stays bounded."""
        if len(self.index) > KNOWN:
            self.forget()
        new = [(w, clean(w)) for w in words if w not in self.index]
        parts = {c: ps for c in {c for _, c in new if c not in self.cleaned} if (ps := pieces(c))}
        distinct = {p: i for i, p in enumerate(dict.fromkeys(p for ps in parts.values() for p in ps))}
        mapped = (similarities(list(distinct), self.landmarks) @ self.root).astype(np.float32)
        rows = mapped[[distinct[ps[0]] for ps in parts.values()]]
        for i, ps in enumerate(parts.values()):
            if len(ps) > 1:
                rows[i] = mapped[[distinct[p] for p in ps]].max(axis=0)
        self.cleaned.update(zip(parts, range(len(self.table), len(self.table) + len(parts))))
        self.index.update((w, self.cleaned.get(c, 2)) for w, c in new)
        self.table = np.concatenate([self.table, rows])

    def bags(self, data: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each sentence of each text (one for a text without any), and where each text's rows begin."""
        marked = []
        for text in data:
            text = (text or "").replace(_TEXT_MARK, " ").replace(_SENTENCE_MARK, " ")
            if _SPELT.search(text):
                text = f" {_SENTENCE_MARK} ".join(" ".join([x, *spelt(x)]) for x in _SENTENCE.split(text))
            else:
                text = _SENTENCE.sub(f" {_SENTENCE_MARK} ", text)
            marked.append(text)
        tokens = f" {_TEXT_MARK} ".join(["", *marked]).split()
        self.learn(set(tokens))
        flat = np.fromiter(map(self.index.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        begin = np.flatnonzero(flat <= 1)
        columns = np.ascontiguousarray(self.table.T)
        rows = np.stack([np.maximum.reduceat(c[flat], begin) for c in columns], axis=1)
        return rows, np.append(np.flatnonzero(flat[begin] == 1), len(begin))


def choose_landmarks(data: list[str], labels: list[int], most: int = LANDMARKS) -> list[str]:
    """Words that speak for toxicity beyond what the largest of as many chance results would.

    The evidence is the root of the likelihood ratio of the word's share of toxic and of other texts; the largest of
    n normal deviates is about sqrt(2 ln n).
    """
    counts = [Counter(), Counter()]
    totals = [max(1, labels.count(0)), max(1, labels.count(1))]
    for text, y in zip(data, labels):
        counts[y].update({p for w in set(text.split()) for p in pieces(clean(w)) if len(p) >= SHORTEST})
    part = lambda n, p: np.where(n > 0, n * np.log(np.maximum(n, 1) / np.maximum(p, 1e-12)), 0)
    words = sorted(counts[1])
    a, b = np.array([counts[1][w] for w in words], dtype=float), np.array([counts[0][w] for w in words], dtype=float)
    share = (a + b) / sum(totals)
    ratio = 2 * (part(a, totals[1] * share) + part(b, totals[0] * share) + part(totals[1] - a, totals[1] * (1 - share)) + part(totals[0] - b, totals[0] * (1 - share)))
    evidence = np.sqrt(np.maximum(ratio, 0)) * np.sign(a / totals[1] - b / totals[0])
    bar = np.sqrt(2 * np.log(max(2, len(words))))
    return [w for e, w in sorted(zip(-evidence, words))[:most] if -e > bar]


def train(data: list[str], labels: list[int]) -> Machine | float:
    """A machine, or the share of toxic texts where there is nothing to tell the classes apart by."""
    y = np.array(labels)
    landmarks = choose_landmarks(data, labels) if len(set(labels)) == 2 else []
    if not landmarks:
        return float(y.mean()) if len(y) else 0.0
    gram = similarities(landmarks, landmarks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T
    rows, first = WordMap(landmarks, root).bags(data)
    seen = [rows[i:j].astype(np.float64) for i, j in zip(first[:-1], first[1:])]
    sign = np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    # The first guess of a text's most toxic sentence is the one nearest to the landmarks.
    chosen = np.array([b[np.argmax(b.max(axis=1))] for b in seen])
    weights, offset = np.zeros(root.shape[1]), 0.0
    for outer in range(3):
        weights, offset = _hinge(chosen, sign, cost)
        chosen = np.array([b[np.argmax(b @ weights)] for b in seen])
    margin = chosen @ weights + offset
    slope, shift = _sigmoid(margin, y)
    return Machine(landmarks, root, weights, offset, slope, shift)


def _hinge(x: np.ndarray, sign: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear support vector machine by averaged subgradient steps."""
    rng = np.random.default_rng(SEED)
    weights, offset, mean, mean_offset, n = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 0
    batch = 64
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            at = order[i : i + batch]
            rate = 0.5 / (1 + 0.05 * epoch)
            bad = sign[at] * (x[at] @ weights + offset) < 1
            pull = (cost[at] * sign[at] * bad) / len(at)
            weights += rate * (pull @ x[at] - REGULAR * weights)
            offset += rate * pull.sum()
            if epoch >= EPOCHS // 2:
                n += 1
                mean += (weights - mean) / n
                mean_offset += (offset - mean_offset) / n
    return mean, mean_offset


def _sigmoid(margin: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[float, float]:
    """Platt's scaling, with smoothed targets."""
    high, low = ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2)
    target = np.where(y == 1, high, low)
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def scores(model: Machine | float, data: list[str | None], words: WordMap | None = None) -> np.ndarray:
    if not isinstance(model, Machine):
        return np.full(len(data), model, dtype=np.float64)
    if not data:
        return np.zeros(0)
    rows, first = (words or WordMap(model.landmarks, model.root)).bags(data)
    margin = np.maximum.reduceat(rows @ model.weights, first[:-1]) + model.offset
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine | float:
    """Fit on at most ``per_class`` labelled rows of each class whose crc32 modulo 5 is not 0."""
    return fitted(labelled(docs, labels, "toxic", remainder("doc_id", 5) != 0, per_class), lambda data, y: train([t.decode("utf-8", "replace") for t in data], y))


def score(docs: DataFrame, model: Machine | float) -> DataFrame:
    """Toxicity of every whole text.

    Null texts count as empty; a text without any known trait, such as an empty one, has the score of a bare
    sentence.  Repeated rows are scored each, an empty table gives no rows, other columns than doc_id and
    text are no inputs.  Returns doc_id, held_out, score and predicted; held_out is false for a null doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordMap(model.landmarks, model.root) if isinstance(model, Machine) else None
        for batch in by_bytes(batches, "text"):
            p = scores(model, batch.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
