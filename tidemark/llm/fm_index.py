"""Compressed full-text index over words: wavelet matrix, backward search, matching statistics up to a bounded length."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words with one count for each word; rank in constant time."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, dtype=np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)
        self.zeros = int(len(bits) - self.before[-1])

    def ones_before(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Symbols 0..2**levels-1; occurrences of a symbol before a place take one rank a level."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.rows, x = levels, [], symbols
        for level in range(levels - 1, -1, -1):
            bit = (x >> level) & 1
            self.rows.append(Bits(bit))
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        #: Where a symbol's run begins after the last level.
        self.begin = self._down(np.arange(1 << levels), np.zeros(1 << levels, dtype=np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for row, level in zip(self.rows, range(self.levels - 1, -1, -1)):
            ones = row.ones_before(i)
            i = np.where((c >> level) & 1, row.zeros + ones, i - ones)
        return i

    def counts(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of c before two places each."""
        for row, level in zip(self.rows, range(self.levels - 1, -1, -1)):
            one = ((c >> level) & 1).astype(bool)
            a, b = row.ones_before(lo), row.ones_before(hi)
            lo, hi = np.where(one, row.zeros + a, lo - a), np.where(one, row.zeros + b, hi - b)
        begin = self.begin[c]
        return lo - begin, hi - begin


class FMIndex:
    """Index of passages, given as one run of word numbers with a 0 after each passage, for patterns of up to ``depth`` words.

    Suffixes are sorted by their first ``depth`` words, which is enough for backward search of patterns up to that length.
    ``owner`` is a number for each place; the least one among the occurrences of a full-length pattern is kept.
    """

    def __init__(self, words: np.ndarray, owner: np.ndarray, depth: int):
        self.depth, n = depth, len(words)
        # Ranks by ever more words: as many ranks side by side as fit into one 64-bit key.
        rank, have, ranks = words.astype(np.int64), 1, {1: words.astype(np.int64)}
        while have < depth:
            key, got, bits = rank, have, int(rank.max(initial=0) + 1).bit_length()
            while got < depth:
                size = max(k for k in ranks if k <= depth - got)
                more = int(ranks[size].max(initial=0) + 1).bit_length()
                if bits + more > 63:
                    break
                after = np.zeros(n, dtype=np.int64)
                after[:n - got] = ranks[size][got:] + 1
                key, got, bits = (key << more) | after, got + size, bits + more
            rank, have = np.unique(key, return_inverse=True)[1], got
            ranks[have] = rank
        order = np.argsort(rank, kind="stable")
        self.symbols = int(words.max(initial=0)) + 1
        self.levels = max(1, (self.symbols - 1).bit_length())
        self.bwt = WaveletMatrix(words[order - 1].astype(np.int64), self.levels)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=self.symbols))])
        # Words that neighbouring suffixes share, up to the depth.
        self.shared, same = np.zeros(n, dtype=np.int8), np.ones(n - 1, dtype=bool)
        padded = np.concatenate([words, np.full(depth, -1, dtype=words.dtype)])
        for d in range(depth):
            at = padded[order + d]
            same &= at[1:] == at[:-1]
            self.shared[1:] += same
        heads = np.flatnonzero(self.shared < depth)
        group = np.cumsum(self.shared < depth) - 1
        self.least = np.minimum.reduceat(owner[order], heads)[group]
        self.n, self._bounds = n, {}

    def bounds(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row, the range of rows that share its first ``depth`` words."""
        if depth not in self._bounds:
            heads = np.flatnonzero(self.shared < depth) if depth else np.zeros(1, dtype=np.int64)
            sizes = np.diff(np.append(heads, self.n))
            self._bounds[depth] = np.repeat(heads, sizes), np.repeat(heads + sizes, sizes)
        return self._bounds[depth]

    def _step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = self.first[c]
        before, upto = self.bwt.counts(c, lo, hi)
        return base + before, base + upto

    def matching_statistics(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word of the streamed passages: words that match from there on, at most ``depth``, and the least owner of a
        full match (else -1). Word -1 is not in the index.

        All passages are read from right to left at once. A match grows by a backward step; where it cannot, or is full, it
        gives up its last word, which widens the range to the rows that share the rest.
        """
        out, least = np.zeros(len(words), dtype=np.int8), np.full(len(words), -1, dtype=np.int64)
        turn = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[turn], lengths[turn]
        lo, hi = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), self.n, dtype=np.int64)
        have = np.zeros(len(starts), dtype=np.int64)
        for t in range(1, int(lengths.max(initial=0)) + 1):
            live = int(np.searchsorted(-lengths, -t, side="right"))
            at = starts[:live] + lengths[:live] - t
            todo = np.arange(live)
            while len(todo):
                c = words[at[todo]]
                known = c >= 0
                have[todo[~known]], lo[todo[~known]], hi[todo[~known]] = 0, 0, self.n
                todo, c = todo[known], c[known]
                new_lo, new_hi = self._step(c, lo[todo], hi[todo])
                ok = new_hi > new_lo
                lo[todo[ok]], hi[todo[ok]] = new_lo[ok], new_hi[ok]
                have[todo[ok]] += 1
                todo = todo[~ok & (have[todo] > 0)]
                have[todo] -= 1
                self._shorten(todo, have, lo, hi)
            out[at] = have[:live]
            full = np.flatnonzero(have[:live] == self.depth)
            least[at[full]] = self.least[lo[full]]
            have[full] -= 1
            self._shorten(full, have, lo, hi)
        return out, least

    def _shorten(self, rows: np.ndarray, have: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        for d in np.unique(have[rows]):
            some = rows[have[rows] == d]
            left, right = self.bounds(int(d))
            lo[some], hi[some] = left[lo[some]], right[lo[some]]
