"""A run-length index: the run-compressed Burrows-Wheeler transform of a text with suffix
array samples at run ends, and matching statistics streamed over it.

Patterns are streamed from right to left, many at once.  The state of a pattern is a row
of the transform and the length of the longest match that begins there.  If the row's run
has the next symbol, the match grows by one step of the last-to-first mapping; if not, it
goes to the nearer run end, above or below, that has the symbol and shares more.  So only
run heads and the samples at run ends are looked at, never the whole suffix array.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, classes_at: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """The suffix array of symbols 0 to 256, by prefix doubling from 7 symbols; and, for each position, the
    class of its first `classes_at` symbols (None if that is 0)."""
    n = len(text)
    symbols = np.concatenate([text.astype(np.int64) + 1, np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key * 258 + symbols[k : k + n]
    _, rank = np.unique(key, return_inverse=True)
    length, classes = 7, None

    def joined(first: np.ndarray, step: int) -> np.ndarray:
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = first[step:] + 1
        return first * (n + 1) + second

    while True:
        if classes is None and classes_at and 2 * length >= classes_at:
            classes = np.unique(joined(rank, classes_at - length), return_inverse=True)[1]
        if (n == 0 or rank.max() == n - 1) and (classes is not None or not classes_at):
            break
        _, rank = np.unique(joined(rank, length), return_inverse=True)
        length *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, classes


class RunLengthIndex:
    """text: symbols 1 to 256; 0 ends a string and matches nothing."""

    def __init__(self, text: np.ndarray, classes_at: int = 0):
        self.text = text.astype(np.int16)
        order, self.classes = suffix_order(text, classes_at)
        last = self.text[order - 1]  # the symbol before each suffix; round to the end before the first
        self.first = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]])) if len(last) else np.zeros(0, np.int64)
        self.end = np.append(self.first[1:], len(last)) - 1
        self.head = last[self.first].astype(np.int64)
        self.sample_first, self.sample_end = order[self.first], order[self.end]
        size = self.end - self.first + 1
        by = np.argsort(self.head, kind="stable")
        before = np.cumsum(size[by]) - size[by]
        # where a run's first row goes: symbols smaller than its own, then its own symbol's earlier runs
        self.to = np.empty(len(by), np.int64)
        self.to[by] = before
        self.runs = len(self.first)
        self.places = self.head[by] * self.runs + by  # runs ordered by symbol and place

    def run_of(self, row: np.ndarray) -> np.ndarray:
        """The run of each row, by a search among the runs' first rows."""
        return np.searchsorted(self.first, row, "right") - 1

    def matching_statistics(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns: one a row, symbols 1 to 256, padded with 0 at the right.  For each
        place, the length of the longest match that begins there and where the text has it."""
        n, wide = patterns.shape
        lengths, where = np.zeros((n, wide), np.int64), np.zeros((n, wide), np.int64)
        if not self.runs:
            return lengths, where
        row, at, size = np.zeros(n, np.int64), np.full(n, self.sample_first[0]), np.zeros(n, np.int64)
        padded = np.concatenate([self.text, np.zeros(wide + 1, np.int16)])
        for column in range(wide - 1, -1, -1):
            symbol = patterns[:, column].astype(np.int64)
            run = self.run_of(row)
            miss = np.flatnonzero((self.head[run] != symbol) & (symbol > 0))
            if len(miss):
                place = np.searchsorted(self.places, symbol[miss] * self.runs + run[miss])
                best, b_row, b_at = np.full(len(miss), -1), np.zeros(len(miss), np.int64), np.full(len(miss), self.sample_first[0])
                for side in (-1, 0):
                    p = np.clip(place + side, 0, self.runs - 1)
                    there = self.places[p] % self.runs
                    found = (place + side == p) & (self.head[there] == symbol[miss])
                    spot = self.sample_end[there] if side else self.sample_first[there]
                    common = self._common(padded, spot, patterns, miss, column + 1, size[miss])
                    take = found & (common > best)
                    best[take], b_at[take] = common[take], spot[take]
                    b_row[take] = (self.end[there] if side else self.first[there])[take]
                none = best < 0
                row[miss], at[miss], size[miss] = b_row, b_at, np.maximum(best, 0)
                run = self.run_of(row)
                absent = miss[none]
            else:
                absent = miss
            go = symbol > 0
            go[absent] = False
            step = np.flatnonzero(go)
            row[step] = self.to[run[step]] + row[step] - self.first[run[step]]
            at[step] = (at[step] - 1) % len(self.text)
            size[step] += 1
            size[~go] = 0
            lengths[:, column], where[:, column] = size, at
        return lengths, where

    @staticmethod
    def _common(padded: np.ndarray, spot: np.ndarray, patterns: np.ndarray, who: np.ndarray, column: int, most: np.ndarray) -> np.ndarray:
        """How many symbols the text from spot on shares with the patterns from column on, up to `most`."""
        wide = min(patterns.shape[1] - column, int(most.max(initial=0)))
        if wide <= 0:
            return np.zeros(len(who), np.int64)
        across = np.arange(wide)
        same = padded[spot[:, None] + across] == patterns[who, column : column + wide]
        return np.minimum(np.where(same.all(1), wide, same.argmin(1)), most)
