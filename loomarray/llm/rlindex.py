"""A run-length index: the run-compressed Burrows-Wheeler transform of many short texts, sampled at run ends."""

from __future__ import annotations

import math

import numpy as np


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many symbols from places `a` and from places `b` on are equal, `most` at the most; ends count as symbols."""
    n, each = len(text), 4  # symbols compared at once
    padded = np.concatenate([text, np.zeros(most + each, text.dtype)]).astype(np.uint64)
    word = sum(padded[k : n + most + k] << np.uint64(16 * k) for k in range(each))
    out, alive = np.full(len(a), most, np.int64), np.arange(len(a))
    for t in range(0, most, each):
        differ = word[a[alive] + t] ^ word[b[alive] + t]
        apart = differ > 0
        lowest = differ[apart] & (~differ[apart] + np.uint64(1))
        out[alive[apart]] = np.minimum(t + np.log2(lowest.astype(np.float64)).astype(np.int64) // 16, most)
        alive = alive[~apart]
    return out


class RunLengthIndex:
    """Index of `texts` (bytes), whose ends sort by their order.

    Kept for each run of the transform: its symbol, its first row, where its first row maps to
    (LF), and the suffixes of its first and last row, with what those share at most with the
    suffixes beside them, cut at `depth`.  Nothing is kept for each row.
    """

    #: Bits of a word in which two ranks and a place are sorted together.
    PACKED = 63

    def __init__(self, texts: list[bytes], depth: int):
        self.depth, m = depth, len(texts)
        self.sizes = sizes = np.fromiter(map(len, texts), np.int64, m)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        present = np.unique(flat)
        code = np.zeros(256, np.int64)
        code[present] = np.arange(1, len(present) + 1)
        self.code, self.symbols = code, len(present) + 1
        # texts with one end each, one after the other; ends are 0
        self.at = at = np.cumsum(sizes + 1) - (sizes + 1)
        self.n = n = int((sizes + 1).sum())
        left = self.left()
        text = np.zeros(n, np.int16)
        text[left > 0] = code[flat]
        rows = self._sort(text, left)
        before = np.where(rows > 0, text[rows - 1], 0)
        start = np.zeros(n, bool)
        start[at] = True
        before[start[rows]] = 0  # a whole text follows an end
        first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if n else np.empty(0, np.int64)
        self.run_start, self.run_symbol = first, before[first]
        self.run_size = size = np.diff(np.concatenate([first, [n]]))
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        order = np.argsort(self.run_symbol, kind="stable")
        s = size[order]
        ahead = np.cumsum(s) - s  # of runs with smaller symbols or the same, earlier: just C + rank
        self.run_to = np.empty(len(first), np.int64)
        self.run_to[order] = ahead
        self.sample_first, self.sample_last = rows[first], rows[np.concatenate([first[1:] - 1, [n - 1]])] if n else rows[:0]
        self.by_symbol = {c: np.flatnonzero(self.run_symbol == c) for c in range(self.symbols)}
        del rows, before
        self._sample(order, text, left)

    def left(self) -> np.ndarray:
        """Symbols from each place to the end of its text."""
        return (np.repeat(self.at + self.sizes, self.sizes + 1) - np.arange(self.n)).astype(np.int32)

    def _sample(self, order: np.ndarray, text: np.ndarray, left: np.ndarray):
        """Places whose neighbour above does not follow from the next place's, their neighbours, and what they share.

        Where rows next to each other have one symbol before them, the rows of those symbols are
        next to each other too.  So only the symbol before a run's first row starts anew: above it
        stands the symbol before the last row of the run that precedes it among its symbol's runs
        (or among the symbol's before).  Ends start anew as well; above each is the text before's.
        """
        ends = self.at + self.sizes
        head = self.run_symbol[order] > 0
        place, above = self.sample_first[order] - 1, np.concatenate([[0], self.sample_last[order][:-1] - 1])[: len(order)]
        above[head & np.concatenate([[False], ~head[:-1]])[: len(order)]] = self.n - 1  # the least symbol comes after the last end
        place, above = place[head], above[head]
        shared = np.minimum(common(text, place, above, self.depth), np.minimum(left[place], left[above]))
        place, above = np.concatenate([place, ends]), np.concatenate([above, ends[:1], ends[:-1]])
        by = np.argsort(place)
        self.sampled, self.above, self.shared = place[by], above[by], np.concatenate([shared, np.zeros(len(ends), shared.dtype)])[by]

    def _sort(self, text: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Rows in suffix order, by prefix doubling.

        Keys carry their place in the low bits, so sorting values sorts places.
        """
        n = len(text)
        if not n:
            return np.empty(0, np.int64)
        low = np.uint64(n.bit_length())
        place, mask = np.arange(n, dtype=np.uint64), np.uint64((1 << n.bit_length()) - 1)

        def ranks(high: np.ndarray, next_: np.ndarray | None = None) -> tuple[np.ndarray, int]:
            """Dense ranks of keys (high, next_), and how many there are."""
            if next_ is not None and 3 * n.bit_length() > self.PACKED:  # too many rows to pack: by the second, then by the first with the place in that order
                order = (np.sort((next_ << low) | place) & mask).astype(np.int64)
                key = np.sort((high[order] << low) | place)
                order = order[(key & mask).astype(np.int64)]
                key >>= low
                new = key[1:] != key[:-1]
                key = next_[order]
                new |= key[1:] != key[:-1]
            else:
                key = high if next_ is None else (high << low) | next_
                key = np.sort((key << low) | place)
                order = (key & mask).astype(np.int64)
                key >>= low
                new = key[1:] != key[:-1]
            step = np.zeros(n, np.uint64)
            np.cumsum(new, out=step[1:])
            out = np.empty(n, np.uint64)
            out[order] = step
            return out, int(step[-1]) + 1

        def moved(rank: np.ndarray, by: int) -> np.ndarray:
            """One more than the rank of what stands `by` symbols on; beyond the end, 0."""
            out = np.zeros(n, np.uint64)
            if by < n:
                np.multiply(rank[by:] + np.uint64(1), left[: n - by] >= by, out=out[: n - by])
            return out

        # the first word: as many symbols as fit beside the place, by doubling and then the rest
        base, bits = self.symbols, 63 - n.bit_length()
        most = max(1, min(self.depth, int(bits / math.log2(max(2, base)))))
        words = [text.astype(np.uint64)]  # of 1, 2, 4, ... symbols

        def joined(key: np.ndarray, word: int, other: np.ndarray, size: int) -> np.ndarray:
            more = np.zeros(n, np.uint64)
            if word < n:
                np.multiply(other[word:], left[: n - word] > word, out=more[: n - word])
            return key * np.uint64(base**size) + more

        while 2 << (len(words) - 1) <= most:
            half = 1 << (len(words) - 1)
            words.append(joined(words[-1], half, words[-1], half))
        key, word = words[-1], 1 << (len(words) - 1)
        for k in range(len(words) - 2, -1, -1):
            if word + (1 << k) <= most:
                key, word = joined(key, word, words[k], 1 << k), word + (1 << k)
        del words
        rank, kinds = ranks(key)
        depth, longest = word, int(left.max(initial=0))
        while depth <= longest and kinds < n:
            rank, kinds = ranks(rank, moved(rank, depth))
            depth *= 2
        return (np.sort((rank << low) | place) & mask).astype(np.int64)  # equal suffixes by their texts' order

    @property
    def runs(self) -> int:
        return len(self.run_start)

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of the indexed texts: for each place, how much its suffix shares with the one
        above it in suffix order, cut at `depth`, and the place of that one.

        Read off the samples: `k` places ahead of a sampled one, `k` symbols more are shared.
        """
        sample = np.repeat(np.arange(len(self.sampled)), np.diff(self.sampled, prepend=-1))
        away = self.sampled[sample] - np.arange(self.n)
        return np.minimum(self.shared[sample] + away, self.depth), self.above[sample] - away

    def stream(self, value: np.ndarray, missing) -> np.ndarray:
        """For every place with `depth` symbols: the least `value` (one a text) of all places that have the same.

        Long matches hang together in chains, each place by the one above it; chains are followed in
        leaps that double.  Result, text after text and an end each; `missing` where a text is too short.
        """
        out = np.full(self.n, missing)
        own = np.flatnonzero(self.left() >= self.depth)
        length, above = self.statistics()
        number = np.zeros(self.n, np.int64)
        number[own] = np.arange(len(own))
        up = np.where(length[own] >= self.depth, number[above[own]], np.arange(len(own)))
        del length, above, number
        least = np.repeat(value, self.sizes + 1)[own]
        while True:
            further = up[up]
            least = np.minimum(least, least[up])
            if (further == up).all():
                break
            up = further
        whole = least.copy()
        np.minimum.at(whole, up, least)
        out[own] = whole[up]
        return out

    def _rank(self, c: int, row: int) -> int:
        """How often symbol `c` stands in the transform before `row`."""
        own = self.by_symbol.get(c, ())
        k = int(np.searchsorted(self.run_start[own], row)) if len(own) else 0
        if not k:
            return 0
        size = self.run_size[own]
        return int(size[:k].sum() - max(0, self.run_start[own[k - 1]] + size[k - 1] - row))

    def find(self, pattern: bytes) -> tuple[int, tuple[int, int] | None]:
        """Occurrences of a pattern, and one of them as (text, place): backward search, with the last
        occurrence followed through the samples at run ends."""
        low, high = 0, self.n
        held = int(self.sample_last[-1]) if self.n else 0  # a suffix in the last row of the interval
        for x in reversed(pattern):
            c = int(self.code[x])
            if not c:
                return 0, None
            last = int(np.searchsorted(self.run_start, high - 1, side="right")) - 1
            a, b = self.smaller[c] + self._rank(c, low), self.smaller[c] + self._rank(c, high)
            if a >= b:
                return 0, None
            if self.run_symbol[last] == c:
                held -= 1
            else:  # the last run of c above
                own = self.by_symbol[c]
                held = int(self.sample_last[own[np.searchsorted(own, last) - 1]]) - 1
            low, high = int(a), int(b)
        text = int(np.searchsorted(self.at, held, side="right")) - 1
        return high - low, (text, held - int(self.at[text]))
