"""Token counts by rank-synchronous array merging.

The pieces of a SentencePiece BPE model become a table of pair ranks. A batch
of pre-tokens (a run of spaces with the word after it; no piece spans more) is
held as ragged numpy arrays; each round, every sequence merges its lowest-rank
pair at all its places, until no pair is left. Symbols that survive are the
tokens; one that is no piece counts as its UTF-8 bytes (byte fallback).

Where a piece has a rank above that of a pair it may enter later, only the
leftmost place is merged in a round, which keeps the library's order. Runs of
spaces have equal scores, so they are merged from the left, by length alone.

Nulls count as empty texts, 0 tokens. Each text is counted whole; counts of
pre-tokens are kept in a bounded cache of the Python worker.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, map_texts
from .ragged import PairMerger

SPACE = "▁"
#: Pre-tokens whose counts a worker keeps; beyond, the cache starts anew.
CACHE_WORDS = 200_000
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class PieceModel:
    """Pair ranks of a model file, with counts of pre-tokens."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {
            sp.id_to_piece(i): sp.get_score(i)
            for i in range(sp.vocab_size())
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))
        }
        if any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and p.strip(SPACE) for p in pieces):
            raise ValueError("a piece spans words")
        self.pieces = pieces
        self.runs = {len(p) for p in pieces if not p.strip(SPACE)}
        symbols = sorted({c for p in pieces for c in p} | set(pieces))
        number = {s: i for i, s in enumerate(symbols)}
        #: Tokens that a surviving symbol stands for.
        self.weight = np.array([1 if s in pieces else len(s.encode()) for s in symbols], np.int64)
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        lefts, rights, ranks, made = [], [], [], []
        for p, score in pieces.items():
            if len(p) > 1 and p.strip(SPACE):
                for k in range(1, len(p)):
                    a, b = number.get(p[:k]), number.get(p[k:])
                    if a is not None and b is not None:
                        lefts.append(a)
                        rights.append(b)
                        ranks.append(order[score])
                        made.append(number[p])
        self.merger = PairMerger(*(np.array(x, np.int64) for x in (lefts, rights, ranks, made)), len(symbols))
        self.by_code = np.full(0x110000, -1, np.int32)
        for s, i in number.items():
            if len(s) == 1:
                self.by_code[ord(s)] = i
        self.space = number[SPACE]
        #: Of words after one space (or, beginning with it, a line end), of pre-tokens as they stand, and of runs of spaces.
        self.words: dict[str, int] = {}
        self.chunks: dict[str, int] = {}
        self.counts: dict[str, int] = {}

    def run_tokens(self, n: int) -> int:
        """Tokens of a run of ``n`` spaces: equal scores, so the leftmost pair that makes a piece merges first."""
        got = self.counts.get(key := SPACE * n) if n < 64 else None
        if got is None:
            done, back, left = [1], [], n - 1
            while back or left:  # what was merged last, if anything, stands before the spaces that are left
                if back:
                    step = back.pop()
                else:
                    step, left = 1, left - 1
                if done[-1] + step in self.runs:
                    done[-1] += step
                    if len(done) > 1:
                        back.append(done.pop())
                else:
                    done.append(step)
            got = len(done)
            if n < 64:
                self.counts[key] = got
        return got

    def tokens(self, words: list[str]) -> np.ndarray:
        """Token counts of pre-tokens, each with its leading spaces written as U+2581."""
        out = np.zeros(len(words), np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(lens > 1 << 16):
            out[i] = self._merge([words[i]], lens[i : i + 1])[0]
        order = np.flatnonzero(lens <= 1 << 16)
        order = order[np.argsort(lens[order], kind="stable")]
        total = np.cumsum(lens[order])
        start = 0
        while start < len(order):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + (1 << 18), "right")))
            at = order[start:stop]
            out[at] = self._merge([words[i] for i in at], lens[at])
            start = stop
        return out

    def _merge(self, words: list[str], lens: np.ndarray) -> np.ndarray:
        """Characters of no piece fall back to their UTF-8 bytes; leading spaces that survive count by their run's length."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym, seq = self.by_code[code], np.repeat(np.arange(len(words)), lens)
        count = np.zeros(len(words), np.int64)
        if (odd := np.flatnonzero(sym < 0)).size:
            c = code[odd]
            np.add.at(count, seq[odd], 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF))
        sym, seq = self.merger.merge(sym, seq)
        space = sym == self.space
        rest = ~space & (sym >= 0)
        count += np.bincount(seq[rest], self.weight[sym[rest]], len(words)).astype(np.int64)
        ids, n = np.unique(seq[space], return_counts=True)
        for k in np.unique(n):
            count[ids[n == k]] += self.run_tokens(int(k))
        return count

    def text_tokens(self, texts: list[str | None]) -> list[int]:
        """Token counts of whole texts."""
        split, fresh, odd = [], set(), set()
        for t in texts:
            if not t:
                split.append((None, ()))
                continue
            t = t.replace(" ", SPACE)
            if SPACE * 2 in t or t[0] == SPACE or t[-1] == SPACE or SPACE + "\n" in t:
                split.append((self.chunks, words := _CHUNK.findall(SPACE + t)))
                odd.update(words)
            else:  # a word stands for itself after one space, or after a line end that it begins with
                split.append((self.words, words := t.replace("\n", f"{SPACE}\n").split(SPACE)))
                fresh.update(words)
                if t[0] == "\n":  # the first word of all is a space alone
                    words[0] = ""
        for cache, seen, plain in ((self.words, fresh, False), (self.chunks, odd, True)):
            if len(cache) > CACHE_WORDS:
                cache.clear()
            new = [w for w in seen if w not in cache]
            ends = np.fromiter((not plain and w[:1] == "\n" for w in new), np.int64, len(new))
            bare = [w if plain else w[1:] if w[:1] == "\n" else SPACE + w for w in new]
            cache.update(zip(new, (self.tokens(bare) + ends).tolist(), strict=True))
            cache[""] = 1
        return [sum(map(cache.__getitem__, words)) if words else 0 for cache, words in split]


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of this worker process."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def count_tokens(docs: DataFrame, model_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text; no shuffle.

    ``model_path`` must be readable on every executor; by default it is found there in the installed vocabularies.
    """

    def kernel():
        path = model_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        m = model(path)

        def step(batch: pa.RecordBatch) -> dict:
            texts = column(batch, text_col)
            n = m.text_tokens(texts)
            return {"doc_id": column(batch, id_col), "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        def close() -> None:
            m.words.clear()
            m.chunks.clear()

        step.close = close
        return step

    return map_texts(docs.select(id_col, text_col), kernel, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", text_col)
