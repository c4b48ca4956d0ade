"""Run-length index of a repetitive text: run-compressed Burrows-Wheeler transform with samples at run ends, in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes packed in the first sorting key: nine bits each, so that the end of a piece sorts before every byte.
PACKED = 7


def suffix_order(keys: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffix array of a text of pieces. ``keys`` holds the first bytes of every suffix, ``left`` the bytes up to the end of
    its piece. Suffixes that are equal up to that end are in order of position."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    head = keys[order]
    fresh = np.concatenate(([True], head[1:] != head[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    depth = PACKED
    while True:
        alone = fresh & np.concatenate((fresh[1:], [True]))
        rows = np.flatnonzero(~alone)
        if not len(rows):
            return order
        part = order[rows]
        ended = left[part] < depth
        further = np.where(ended, part, rank[np.minimum(part + depth, n - 1)])
        group = rank[part]
        by = np.lexsort((further, group))
        part, further, group = part[by], further[by], group[by]
        order[rows] = part
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (further[1:] != further[:-1])))
        fresh[rows] = new
        rank[part] = np.maximum.accumulate(np.where(new, rows, 0))
        depth *= 2


class RunIndex:
    """Index of pieces (bytes). Matches never cross the end of a piece."""

    def __init__(self, pieces: list[bytes]):
        raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        sizes = np.array([len(p) + 1 for p in pieces])
        self.starts = np.cumsum(sizes) - sizes
        self.n = n = len(raw)
        self.left = np.repeat(self.starts + sizes - 1, sizes) - np.arange(n)
        text = raw.astype(np.int64) + 1
        text[self.left == 0] = 0
        padded = np.concatenate((text, np.zeros(PACKED, np.int64)))
        keys = np.zeros(n, np.int64)
        for k in range(PACKED):
            keys = keys << 9 | np.where(self.left > k, padded[k:k + n], 0)
        order = suffix_order(keys, self.left)
        transform = text[order - 1]
        # A run starts where the symbol changes; ends of pieces differ from one another and start runs of their own.
        run = np.flatnonzero(np.concatenate(([True], (transform[1:] != transform[:-1]) | (transform[1:] == 0))))
        self.heads, self.lengths = transform[run], np.diff(np.append(run, n))
        # At each run's start: its text position, the position one row above (the end of the run before), their match.
        at, above = order[run], order[run - 1]
        match = self.common(keys, at, above)
        match[run == 0] = 0
        by = np.argsort(at)
        self.at, self.above, self.match = at[by], above[by], match[by]

    def common(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of suffixes, up to the end of the shorter piece."""
        most = np.minimum(self.left[a], self.left[b])
        length = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            at = length[live]
            inside = at < most[live]
            live, at = live[inside], at[inside]
            same = keys[a[live] + at] == keys[b[live] + at]
            length[live[same]] += PACKED
            rest, at = live[~same], at[~same]
            # the first of the packed bytes that differs
            differ = keys[a[rest] + at] ^ keys[b[rest] + at]
            for k in range(PACKED - 1, 0, -1):
                length[rest] += differ >> (9 * k) == 0
            live = live[same]
        return np.minimum(length, most)

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """For every text position the position whose suffix precedes in order, and the length of their match.

        Read from left to right: between two samples both positions move on together and the match loses a byte a step.
        """
        place = np.arange(self.n)
        sample = np.searchsorted(self.at, place, "right") - 1
        moved = place - self.at[sample]
        return self.above[sample] + moved, np.maximum(self.match[sample] - moved, 0)

    def repeated(self, length: int) -> np.ndarray:
        """Whether ``length`` bytes from each position also start at an earlier one."""
        above, match = self.matches()
        place = np.arange(self.n)
        long = match >= length
        root = np.where(long, above, place)
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
        first = np.full(self.n, self.n)
        np.minimum.at(first, root, place)
        return (first[root] < place) & (self.left >= length)
