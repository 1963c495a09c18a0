"""A log-bilinear neural language model in NumPy, trained by noise-contrastive estimation.

The last CONTEXT tokens, each by its vector weighted for its place, add up to a predicted vector. Its products with the vectors of word
classes, plus their biases, give the scores of the classes, and with the vectors of one class's words the scores of words in it; both are
normalised by softmax, so a token costs about as many products as there are classes and words in its class, not as many as there are words.
Classes are ranges of the vocabulary, which is sorted by count, of about equal sums of square roots of counts; the last class is
every token outside the vocabulary.

All parameters are rows of one matrix: vectors of DIM numbers and a bias behind them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

DIM, CONTEXT, CLASSES = 16, 3, 64
#: Tokens of a step and of a stretch that is shuffled; noise classes of a step, noise words of a token.
STEP, STRETCH, NOISE_CLASSES, NOISE_WORDS = 4096, 1 << 17, 16, 2
RATE = 0.1
#: Tokens scored at once.
BATCH = 1 << 14


def classed(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """First word of each class and the number of words, for words in the order of their counts."""
    root = np.sqrt(np.maximum(counts, 1))
    upto = np.cumsum(root) - root / 2
    return np.unique(np.concatenate([np.searchsorted(upto, root.sum() * np.arange(min(classes, max(len(counts), 1))) / classes), [len(counts)]]))


@dataclass
class Shape:
    """What is fixed before training: counts of the vocabulary's words and of all other tokens, and the classes."""

    counts: np.ndarray
    others: float

    def __post_init__(self) -> None:
        n = len(self.counts)
        self.words, self.first = n, classed(self.counts)
        sizes = np.diff(self.first)
        self.classes = len(sizes) + 1
        self.class_of = np.append(np.repeat(np.arange(len(sizes)), sizes), len(sizes)).astype(np.uint16)
        self.sizes = np.append(sizes, 0)
        self.context, self.place = slice(0, n + 2), slice(n + 2, n + 2 + CONTEXT)
        self.group = slice(self.place.stop, self.place.stop + self.classes)
        self.word = slice(self.group.stop, self.group.stop + n)
        self.rows = self.word.stop
        mass = np.maximum(self.counts.astype(float), 0.1)
        self.upto = np.concatenate([[0.0], np.cumsum(mass)])
        total = np.append(self.upto[self.first[1:]] - self.upto[self.first[:-1]], max(self.others, 0.1))
        self.log_class = np.log(total / total.sum()).astype(np.float32)
        self.log_word = (np.log(mass) - np.log(total[self.class_of[:n]])).astype(np.float32)

    def start(self, seed: int = 3) -> np.ndarray:
        """First parameters: the distribution of the counts, whatever the context."""
        t = np.random.default_rng(seed).normal(0, 0.1, (self.rows, DIM + 1)).astype(np.float32)
        t[:, DIM] = 0
        t[self.place, :DIM] += 1
        t[self.group, DIM], t[self.word, DIM] = self.log_class, self.log_word
        return t


def contexts(tokens: np.ndarray, starts: np.ndarray, shape: Shape) -> np.ndarray:
    """(tokens, CONTEXT) tokens before each, of the same text; in front of a text stands a token of its own."""
    n = len(tokens)
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    out = np.full((n, CONTEXT), shape.words + 1, dtype=np.uint16 if shape.words < 65_000 else np.int32)
    for i in range(CONTEXT):
        some = np.flatnonzero(place > i)
        out[some, i] = tokens[some - i - 1]
    return out


def predicted(t: np.ndarray, shape: Shape, context: np.ndarray) -> np.ndarray:
    """(tokens, DIM) predicted vectors."""
    out = np.zeros((len(context), DIM), np.float32)
    for i, weight in enumerate(t[shape.place, :DIM]):
        out += t[context[:, i], :DIM] * weight
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gathered(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of g that go to the same place."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.add.reduceat(g[order], first, axis=0)


class Trainer:
    """Steps of noise-contrastive estimation from given parameters; seen counts what each row of them has learned from."""

    def __init__(self, t: np.ndarray, shape: Shape, seed: int) -> None:
        self.t, self.shape, self.rng = t.copy(), shape, np.random.default_rng(seed)
        self.square = np.full(t.shape, 1e-3, np.float32)
        self.seen = np.zeros(len(t), np.float32)

    def _move(self, rows: np.ndarray | slice, g: np.ndarray) -> None:
        square = self.square[rows] + g * g
        self.square[rows] = square
        self.t[rows] -= RATE * g / np.sqrt(square)

    def learn(self, tokens: np.ndarray, starts: np.ndarray) -> None:
        """One pass over texts; tokens outside the vocabulary have the number of its words."""
        context = contexts(tokens, starts, self.shape)
        for i in range(0, len(tokens), STRETCH):
            order = i + self.rng.permutation(min(STRETCH, len(tokens) - i))
            for j in range(0, len(order), STEP):
                some = order[j : j + STEP]
                self.step(context[some], tokens[some])

    def step(self, context: np.ndarray, y: np.ndarray) -> None:
        t, s, n = self.t, self.shape, len(y)
        weights, groups = t[s.place, :DIM].copy(), t[s.group].copy()
        vectors = [t[context[:, i], :DIM] for i in range(CONTEXT)]
        q = sum(v * w for v, w in zip(vectors, weights, strict=True))

        # Classes: one draw of noise for the step; error holds the derivative by each score.
        c = s.class_of[y]
        noise = np.bincount(np.searchsorted(np.cumsum(np.exp(s.log_class)), self.rng.uniform(size=NOISE_CLASSES) * 0.999999), minlength=s.classes)
        margin = q @ groups[:, :DIM].T + (groups[:, DIM] - s.log_class - np.float32(np.log(NOISE_CLASSES)))
        drawn = np.flatnonzero(noise)
        error = np.zeros((n, s.classes), np.float32)
        error[:, drawn] = _sigmoid(margin[:, drawn]) * noise[drawn].astype(np.float32)
        own = np.arange(n)
        error[own, c] += _sigmoid(margin[own, c]) - 1
        dq = error @ groups[:, :DIM]
        self._move(s.group, np.concatenate([error.T @ q, error.sum(axis=0)[:, None]], axis=1))
        self.seen[s.group] += n

        # Words of classes that hold several: noise of the same class for each token.
        some = np.flatnonzero(s.sizes[c] > 1)
        if len(some):
            mine, k = c[some], NOISE_WORDS
            low, high = s.upto[s.first[mine]], s.upto[s.first[mine + 1]]
            drawn = np.searchsorted(s.upto, low[:, None] + self.rng.uniform(size=(len(some), k)) * (high - low)[:, None], side="right") - 1
            at = np.concatenate([y[some][:, None], np.clip(drawn, s.first[mine][:, None], s.first[mine + 1][:, None] - 1)], axis=1)
            rows = t[s.word.start + at]
            here = q[some]
            err = _sigmoid(np.einsum("nd,nkd->nk", here, rows[..., :DIM]) + rows[..., DIM] - s.log_word[at] - np.float32(np.log(k)))
            err[:, 0] -= 1
            dq[some] += np.einsum("nk,nkd->nd", err, rows[..., :DIM])
            ones = np.concatenate([here, np.ones((len(some), 1), np.float32)], axis=1)
            to, g = _gathered(at.ravel().astype(np.uint16 if s.words < 65_000 else np.int32), (err[:, :, None] * ones[:, None, :]).reshape(-1, DIM + 1))
            rows = s.word.start + to.astype(np.int64)
            self._move(rows, g)
            self.seen[rows] += 1

        to, g = _gathered(context.T.ravel(), np.concatenate([np.pad(dq * w, ((0, 0), (0, 1))) for w in weights]))
        self._move(to.astype(np.int64), g)
        self.seen[to.astype(np.int64)] += 1
        self._move(s.place, np.pad(np.stack([(dq * v).sum(axis=0) for v in vectors]), ((0, 0), (0, 1))))
        self.seen[s.place] += n


def _picked(scores: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Log softmax of each row at one place."""
    top = scores.max(axis=1)
    scores -= top[:, None]
    own = scores[np.arange(len(scores)), which].astype(np.float64)
    return own - np.log(np.exp(scores, out=scores).sum(axis=1, dtype=np.float64))


def log_probabilities(t: np.ndarray, shape: Shape, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Natural logarithms of the probability of each token after those before it in its text, normalised over vocabulary and the class of all others."""
    out = np.zeros(len(tokens))
    context = contexts(tokens, starts, shape)
    for i in range(0, len(tokens), BATCH):
        y = tokens[i : i + BATCH]
        q = predicted(t, shape, context[i : i + BATCH])
        c = shape.class_of[y]
        groups = t[shape.group]
        got = _picked(q @ groups[:, :DIM].T + groups[:, DIM], c)
        order = np.argsort(c, kind="stable")
        bounds = np.searchsorted(c[order], np.arange(shape.classes + 1))
        for k in np.flatnonzero((shape.sizes > 1) & (np.diff(bounds) > 0)):
            rows = order[bounds[k] : bounds[k + 1]]
            words = t[shape.word.start + shape.first[k] : shape.word.start + shape.first[k + 1]]
            got[rows] += _picked(q[rows] @ words[:, :DIM].T + words[:, DIM], y[rows] - shape.first[k])
        out[i : i + BATCH] = got
    return out


def distribution(t: np.ndarray, shape: Shape, context: np.ndarray) -> Iterator[np.ndarray]:
    """Probabilities of all words and, last, of the class of others, after each context."""
    for row in predicted(t, shape, context):
        group = np.exp(t[shape.group, :DIM] @ row + t[shape.group, DIM])
        out = np.append(np.exp(t[shape.word, :DIM] @ row + t[shape.word, DIM]), group[-1] / group.sum())
        for k in range(shape.classes - 1):
            some = slice(shape.first[k], shape.first[k + 1])
            out[some] *= group[k] / group.sum() / out[some].sum()
        yield out
