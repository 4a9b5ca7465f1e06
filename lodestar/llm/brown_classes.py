"""Exchange clustering of words into classes, and the class bigram model's tables.

A bigram model of classes has the likelihood sum x log x over the counts x of class
pairs, less that of both marginals. A word is exchanged by taking it out of its class
and putting it where the likelihood grows most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Discounts lie between these; pseudo-counts of transitions, dealt by class frequency, and of a class itself.
LEAST_DISCOUNT, MOST_DISCOUNT, PULL, TOUCH = 0.1, 0.9, 10.0, 0.1
#: Runs of unknown words up to this length have tables of their own.
RUN = 16
#: The class of words that were never seen, in a sequence of classes.
UNSEEN = 255


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(pairs: np.ndarray) -> float:
    """Logarithm of the likelihood of class pairs, without the part that no exchange changes."""
    return float(xlogx(pairs).sum() - xlogx(pairs.sum(1)).sum() - xlogx(pairs.sum(0)).sum())


def gains(pairs: np.ndarray, after: np.ndarray, before: np.ndarray, own: float, logs: np.ndarray | None = None) -> np.ndarray:
    """What the likelihood grows by if a word joins each class.

    pairs: counts of class pairs without the word; after, before: how often each class
    follows and precedes it; own: how often it follows itself. logs: xlogx(pairs), if known.
    """
    logs = xlogx(pairs) if logs is None else logs
    row, column = pairs.sum(1) + before, pairs.sum(0) + after  # wherever the word goes
    on, off = np.flatnonzero(after), np.flatnonzero(before)
    out = (xlogx(pairs[:, on] + after[on]) - logs[:, on]).sum(1) + (xlogx(pairs[off].T + before[off]) - logs[off].T).sum(1)
    same = pairs.diagonal()
    out += xlogx(same + after + before + own) - xlogx(same + after) - xlogx(same + before) + logs.diagonal()
    n_after, n_before = after.sum() + own, before.sum() + own
    return out - (xlogx(row + n_after) - xlogx(row)) - (xlogx(column + n_before) - xlogx(column))


def moved(pairs: np.ndarray, k: int, after: np.ndarray, before: np.ndarray, own: float, sign: int, logs: np.ndarray | None = None) -> None:
    """Put a word into class k (sign 1) or take it out (-1), in place."""
    pairs[k] += sign * after
    pairs[:, k] += sign * before
    pairs[k, k] += sign * own
    if logs is not None:
        logs[k], logs[:, k] = xlogx(pairs[k]), xlogx(pairs[:, k])


def exchanged(pairs: np.ndarray, classes: np.ndarray, words: np.ndarray, own: np.ndarray, other: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Classes of `words` after each was exchanged once, in order, while all other words stay.

    Bigram k occurs n[k] times: own[k], a place in words, is its first word if
    first[k], else its second, and other[k] is its other word. Class 0 is no word's.
    """
    pairs = pairs.astype(float).copy()
    k, logs = len(pairs), xlogx(pairs)
    now = classes[words].copy()
    place = {w: i for i, w in enumerate(words.tolist())}
    order = np.argsort(own, kind="stable")
    bounds = np.searchsorted(own[order], np.arange(len(words) + 1))
    inside = np.array([place.get(w, -1) for w in other.tolist()], np.int64)
    for i in range(len(words)):
        if words[i] == 0:
            continue
        rows = order[bounds[i]:bounds[i + 1]]
        itself, others = inside[rows] == i, np.where(inside[rows] >= 0, now[inside[rows]], classes[other[rows]])
        side, weight = first[rows], n[rows].astype(float)
        after = np.bincount(others[side & ~itself], weight[side & ~itself], k)
        before = np.bincount(others[~side & ~itself], weight[~side & ~itself], k)
        alone = float(weight[side & itself].sum())
        moved(pairs, now[i], after, before, alone, -1, logs)
        gain = gains(pairs, after, before, alone, logs)
        gain[0] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] > gain[now[i]] + 1e-9:
            now[i] = best
        moved(pairs, now[i], after, before, alone, 1, logs)
    return now


class Joiner:
    """The classes that words outside of the exchange join, from the classes around them: `gains` for many words at once."""

    #: Counts that have a table, so that words meet it by a matrix product.
    TABLES = 3

    def __init__(self, pairs: np.ndarray):
        self.pairs = pairs.astype(float)
        self.logs = xlogx(self.pairs)
        self.tables = [(self._grown(self.pairs.T, c), self._grown(self.pairs, c)) for c in range(1, self.TABLES + 1)]

    @staticmethod
    def _grown(pairs: np.ndarray, c: float) -> np.ndarray:
        return xlogx(pairs + c) - xlogx(pairs)

    def of(self, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Best class of each word; a row of after and of before for each: how often each class follows and precedes it."""
        gain = np.zeros(after.shape)
        for c, tables in enumerate(self.tables, 1):
            for counts, table in zip((after, before), tables, strict=True):
                gain += (counts == c).astype(float) @ table
        for counts, pairs in ((after, self.pairs.T), (before, self.pairs)):
            word, k = np.nonzero(counts > self.TABLES)
            np.add.at(gain, word, self._grown(pairs[k], counts[word, k][:, None]))
        word, k = np.nonzero((after > 0) & (before > 0))
        a, b, same = after[word, k], before[word, k], self.pairs.diagonal()[k]
        gain[word, k] += xlogx(same + a + b) - xlogx(same + a) - xlogx(same + b) + xlogx(same)
        row, column = self.pairs.sum(1) + before, self.pairs.sum(0) + after
        gain -= xlogx(row + after.sum(1, keepdims=True)) - xlogx(row) + xlogx(column + before.sum(1, keepdims=True)) - xlogx(column)
        gain[:, 0] = -np.inf
        return gain.argmax(1)


@dataclass
class ClassBigrams:
    """A fitted model: transitions between classes and what each class keeps for unknown words.

    totals, kinds: occurrences and different words of each class; class 0 is the end's,
    which keeps nothing. A word that occurs n times in class k has (n - discount) / totals[k].
    """

    pairs: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray
    discount: float

    def __post_init__(self):
        k = len(self.totals)
        share = (self.totals + TOUCH) / (self.totals.sum() + TOUCH * k)
        self.moves = (self.pairs + PULL * share) / (self.pairs.sum(1, keepdims=True) + PULL)
        kept = self.discount * self.kinds / np.maximum(self.totals, 1)
        self.unknown = np.where(self.totals > 0, kept, 1.0)
        self.unknown[0] = 0.0
        runs = [self.moves]
        for _ in range(RUN):
            runs.append((runs[-1] * self.unknown) @ self.moves)
        self.runs = np.log10(np.maximum(np.stack(runs), 1e-300))

    def emission(self, n: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Logarithm of a seen word's probability within its class."""
        left = n - np.where(k == 0, 0.0, self.discount)
        return np.log10(left / self.totals[k])

    def path(self, classes: np.ndarray) -> float:
        """Logarithm of the probability of a text's classes, ends included; unseen words may be of any class."""
        known = np.flatnonzero(classes != UNSEEN)
        to = classes[known].astype(int)
        came, gap = np.concatenate(([0], to[:-1])), np.diff(known, prepend=-1) - 1
        brief = gap <= RUN
        total = float(self.runs[gap[brief], came[brief], to[brief]].sum())
        for a, b, length in zip(came[~brief], to[~brief], gap[~brief], strict=True):
            reach = self.moves[a]
            for _ in range(length):
                reach = reach * self.unknown
                scale = reach.sum()
                total += np.log10(scale)
                reach = (reach / scale) @ self.moves
            total += np.log10(reach[b])
        return total


def discount_of(once: int, twice: int) -> float:
    """The share of a count that goes to unknown words, from the words that occur once and twice."""
    return float(np.clip(once / (once + 2 * twice) if once + twice else 0.5, LEAST_DISCOUNT, MOST_DISCOUNT))
