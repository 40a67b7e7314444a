"""Rank-synchronous merging of symbol pairs over ragged numpy arrays."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np

NONE = np.int32(1 << 30)
SHIFT = np.uint64(20)
MULT = np.uint64(0x9E3779B97F4A7C15)
#: Symbols of a part above which its pairs are merged one at a time, from a queue.
LONG = 192


class PairMerger:
    """Merges of (left, right) -> made by rank, applied to many sequences at once.

    Sequences are first cut where no known symbol reaches across: where two neighbours stand side by side in none. Then,
    each round, every part merges its lowest-rank pair at all its places, from the left where places overlap. Where a
    made symbol can enter a pair of lower rank than its own, only the leftmost place is merged in a round, which gives
    the order of one merge at a time. Only pairs beside a merged place are looked up anew. The few parts that are longer
    than LONG could take as many rounds as they have symbols; they take theirs from a queue, n log n in all.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray, symbols: int):
        if symbols >= 1 << 20:
            raise ValueError("too many symbols")
        self.keys = left.astype(np.uint64) << SHIFT | right.astype(np.uint64)
        self.ranks, self.made = rank.astype(np.int32), made.astype(np.int32)
        least = np.full(symbols, NONE, np.int32)
        for part in (left, right):
            np.minimum.at(least, part, self.ranks)
        self.single = np.zeros(int(self.ranks.max()) + 1, bool)
        self.single[self.ranks[least[self.made] < self.ranks]] = True
        # Two hash tables; what collides in the first goes to the second, the few left to a sorted array.
        self.tables, rest = [], np.arange(len(self.keys))
        for mult in (MULT, np.uint64(0xC2B2AE3D27D4EB4F)):
            slot = (self.keys[rest] * mult) >> np.uint64(44)
            table = np.full(1 << 20, -1, np.int32)
            first = np.unique(slot, return_index=True)[1]
            table[slot[first].astype(np.int64)] = rest[first]
            self.tables.append((mult, table))
            rest = np.delete(rest, first)
        self.rest = rest[np.argsort(self.keys[rest])]
        # The first and last of the symbols that each is made of, and which of them stand side by side in any.
        head, tail = np.arange(symbols), np.arange(symbols)
        while True:
            before = head[self.made], tail[self.made]
            head[self.made], tail[self.made] = head[left], tail[right]
            if (head[self.made] == before[0]).all() and (tail[self.made] == before[1]).all():
                break
        self.beside = np.zeros(1 << 20, bool)
        self.beside[self._slot(tail[left], head[right])] = True
        self.queued: tuple[dict[int, int], list[int], list[int]] | None = None

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((((a.astype(np.uint64) << SHIFT) | b.astype(np.uint64)) * MULT) >> np.uint64(44)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair among the known ones, or -1."""
        key = (a.astype(np.uint64) << SHIFT) | b.astype(np.uint64)
        out = np.full(len(key), -1, np.int32)
        for mult, table in self.tables:
            got = table[((key * mult) >> np.uint64(44)).astype(np.int64)]
            fit = (got >= 0) & (self.keys[got] == key)
            out[fit] = got[fit]
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.keys[self.rest], key), len(self.rest) - 1)
            fit = self.keys[self.rest[at]] == key
            out[fit] = self.rest[at][fit]
        return out

    def merge(self, sym: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols and their sequences, in order; ``seq`` must not fall. Symbols below 0 merge with nothing."""
        if not sym.size:
            return sym, seq
        cut = (seq[1:] != seq[:-1]) | (sym[1:] < 0) | (sym[:-1] < 0)
        at = np.flatnonzero(~cut)
        cut[at] = ~self.beside[self._slot(sym[at], sym[at + 1])]
        starts = np.r_[0, np.flatnonzero(cut) + 1]
        size = np.diff(np.r_[starts, len(sym)])
        owner = seq[starts]
        part = np.repeat(np.arange(len(starts)), size)
        done = [(sym[alone], part[alone])] if (alone := np.repeat(size == 1, size)).any() else []
        for k in np.flatnonzero(size > LONG):
            got = self._queue(sym[starts[k] : starts[k] + size[k]])
            done.append((got, np.full(len(got), k)))
        some = np.repeat((size > 1) & (size <= LONG), size)
        done += self._rounds(sym[some], part[some])
        sym, part = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(part, kind="stable")
        return sym[order], owner[part[order]]

    def _rounds(self, sym: np.ndarray, part: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(surviving symbols, their parts), as parts get done."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        if not sym.size:
            return done
        pair = np.full(len(sym), -1, np.int32)
        at = np.flatnonzero(part[1:] == part[:-1])
        pair[at] = self.lookup(sym[at], sym[at + 1])
        while True:
            rank = np.where(pair >= 0, self.ranks[pair], NONE)
            new = np.r_[True, part[1:] != part[:-1]]
            starts = np.flatnonzero(new)
            best = np.minimum.reduceat(rank, starts)
            over = best == NONE
            spread = np.repeat(best, np.diff(np.r_[starts, len(part)]))
            if over.any():
                out = spread == NONE
                done.append((sym[out], part[out]))
                stay = np.flatnonzero(~out)
                if not stay.size:
                    return done
                sym, part, pair, rank, spread = (x[stay] for x in (sym, part, pair, rank, spread))
            hit = np.flatnonzero(rank == spread)
            same = part[hit[1:]] == part[hit[:-1]]
            if same.any():
                keep = np.ones(len(hit), bool)
                chain = np.r_[False, (hit[1:] == hit[:-1] + 1) & same]
                if chain.any():
                    head = np.maximum.accumulate(np.where(chain, 0, np.arange(len(hit))))
                    keep &= (np.arange(len(hit)) - head) % 2 == 0
                keep &= ~self.single[rank[hit]] | np.r_[True, ~same]
                hit = hit[keep]
            sym[hit] = self.made[pair[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, part, pair = sym[stay], part[stay], pair[stay]
            # what is left of, and begins with, each made symbol
            at = hit - np.arange(len(hit))
            at = np.concatenate([at, at[at > 0] - 1])
            pair[at] = -1
            at = at[at < len(sym) - 1]
            at = at[part[at] == part[at + 1]]
            pair[at] = self.lookup(sym[at], sym[at + 1])

    def _queue(self, sym: np.ndarray) -> np.ndarray:
        """What survives of one part, merged a pair at a time: the lowest rank first, then the leftmost."""
        if self.queued is None:
            self.queued = dict(zip(self.keys.tolist(), range(len(self.keys)), strict=True)), self.ranks.tolist(), self.made.tolist()
        known, ranks, made = self.queued
        s, n = sym.tolist(), len(sym)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.lookup(sym[:-1], sym[1:])
        queue = [(ranks[p], i, p) for i, p in enumerate(first.tolist()) if p >= 0]
        heapify(queue)
        while queue:
            _, i, p = heappop(queue)
            j = after[i]
            if s[i] < 0 or j >= n or known.get(s[i] << 20 | s[j]) != p:
                continue
            s[i], s[j] = made[p], -1
            after[i] = k = after[j]
            if k < n:
                prior[k] = i
                if (q := known.get(s[i] << 20 | s[k])) is not None:
                    heappush(queue, (ranks[q], i, q))
            if (h := prior[i]) >= 0 and (q := known.get(s[h] << 20 | s[i])) is not None:
                heappush(queue, (ranks[q], h, q))
        out = np.array(s, np.int32)
        return out[out >= 0]
