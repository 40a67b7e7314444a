"""Best-fit packing by exact complements.

Documents become pieces of at most ``capacity`` tokens. How many pieces there
are of each length is a table of at most ``capacity`` rows, whatever the size
of the corpus, so the packing itself is planned on that table: for each length,
longest first, an index of single, pair and triple sums names pieces that fill
the gap exactly, which are consumed as often as their counts allow; what has no
exact complement is placed by best fit, again by counts. A plan entry says how many sequences have
which lengths at which offsets. Pieces find their places by their rank within
their length; ranks are summed over hashed buckets, so that a length which a
third of all pieces share is spread over many tasks.

Null texts count as empty (one end token). Repeated rows and rows without an id
are packed each; which of equal pieces takes which place doesn't matter, as no
column tells them apart. Ties of length go by bucket, then by id and piece. A
text's ids are held at once, at 4 bytes each, whatever its length. Empty tables
give empty results. Other columns are not needed and ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, map_texts, stage_table
from .ragged import PairMerger

CAPACITY = 4096
END_ID = 1
#: Words and chunks whose ids a task keeps; beyond, the cache starts anew.
CACHE_WORDS = 200_000

#: What needs no normalisation but lower case: printable ASCII and letters of Latin-1, and white space between.
_SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PLAIN = re.compile(r"[ \n\t\r!-~À-ÖØ-öø-ÿ]*")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \n\t\r0-9a-zß-öø-ÿ]+")
_BLANK = str.maketrans("\n\t\r", "   ")


class ChunkTokenizer:
    """Ids of whole texts from a byte-pair tokenizer that drops white space, so that chunks between spaces stand alone.

    Plain letters, digits and signs are cut into words, and the words of many texts that are new are merged here at
    once; all other chunks go to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        #: Ids of words and, as they have characters that words don't, of whole chunks.
        self.words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        vocab, suffix = spec["vocab"], spec["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["merges"]]
        cols = np.array([(vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(pairs)], np.int64).T
        self.merger = PairMerger(*cols, max(vocab.values()) + 1)
        plain = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: Symbols of the bytes of the characters that simple chunks have, inside a word and at its end.
        self.inside, self.final = np.full((2, 256), -1, np.int32)
        for c in map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x100)]):
            for byte, mark in zip(c.encode(), plain.pre_tokenize_str(c)[0][0], strict=True):
                self.inside[byte], self.final[byte] = vocab[mark], vocab[mark + suffix]

    def _merge(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(lens)
        sym = self.inside[flat]
        sym[ends - 1] = self.final[flat[ends - 1]]
        sym, seq = self.merger.merge(sym, np.repeat(np.arange(len(raw)), lens))
        ids = sym.astype("<u4").tobytes()
        at = (4 * np.searchsorted(seq, np.arange(len(raw) + 1))).tolist()
        self.words.update(zip(words, (ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)), strict=True))

    def _cut(self, text: str, odd: set[str]) -> list[str]:
        """The words of a text in order, and its chunks for the library, which are added to ``odd``."""
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return _WORDS.findall(text.lower())
        out = []
        for c in text.translate(_BLANK).split(" "):
            if c:
                if _SIMPLE.fullmatch(c) and "<|" not in c:
                    out += _WORDS.findall(c.lower())
                else:
                    out.append(c)
                    odd.add(c)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        odd: set[str] = set()
        cut = [self._cut(t, odd) if t else () for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        new = {w for words in cut for w in words}.difference(self.words)
        for c in new & odd:
            self.words[c] = np.array(self.lib.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
        fresh = sorted(new - odd, key=len)
        for i in range(0, len(fresh), 20_000):
            self._merge(fresh[i : i + 20_000])
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in cut]


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str | None) -> ChunkTokenizer:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with ``end_id``, cut only where longer than ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()

    def kernel():
        tok = tokenizer(tokenizer_path)

        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, raw in zip(column(batch, id_col), tok.encode(column(batch, text_col)), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for name, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[name].append(v)
            return out

        step.close = tok.words.clear
        return step

    return map_texts(docs.select(id_col, text_col), kernel, "doc_id long, piece int, start long, length long, ids_crc32 long", text_col)


class SumIndex:
    """Single, pair and triple sums of the pieces that ``have`` counts: of each sum, the longest piece of one combination.

    All entries are made at once. Counts only fall, so that an entry whose pieces were used up is moved on to the next
    shorter longest piece when it is looked up, and a sum that has none left is gone for good.
    """

    def __init__(self, have: np.ndarray):
        self.have, size = have, len(have)
        self.two, self.three = np.zeros((2, size), np.int64)
        kinds = np.flatnonzero(have)
        for a in kinds:
            b = kinds[: np.searchsorted(kinds, min(a, size - 1 - a), "right")]
            self.two[a + (b if have[a] > 1 else b[b < a])] = a
        sums = np.flatnonzero(self.two)
        for a in kinds:
            self.three[a + sums[: np.searchsorted(sums, size - a)]] = a

    def _pair(self, total: int, top: int, held: int) -> int:
        """The longest piece, of ``top`` at most, of a pair with this sum, while one piece of length ``held`` is taken; 0 if there is none."""
        a = np.arange(top, (total - 1) // 2, -1)
        b = total - a
        there = (self.have[a] - (a == held) > (a == b)) & (self.have[b] - (b == held) > (a == b))
        return int(a[there.argmax()]) if there.any() else 0

    def pair(self, total: int, held: int = 0) -> tuple[int, int] | None:
        a = self.two[total] = self._pair(total, int(self.two[total]), 0)
        if a and held:
            a = self._pair(total, a, held)
        return (a, total - a) if a else None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        while a := int(self.three[total]):
            if self.have[a] and (rest := self.pair(total - a, a)):
                return (a, *rest)
            lower = np.arange(a - 1, 0, -1)
            there = (self.have[lower] > 0) & (self.two[total - lower] > 0)
            self.three[total] = lower[there.argmax()] if there.any() else 0
        return None

    def exact(self, total: int) -> tuple[int, ...] | None:
        """One, two or three pieces that there are and that have this sum."""
        return (total,) if self.have[total] else self.pair(total) or self.triple(total)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use every piece of ``counts``."""
    have = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        have[n] = c
    done: list[tuple[tuple[int, ...], int]] = []
    index = SumIndex(have)

    for n in range(capacity, 0, -1):
        while have[n]:
            if n == capacity:
                done.append(((n,), int(have[n])))
                have[n] = 0
                break
            have[n] -= 1
            combo = index.exact(capacity - n)
            have[n] += 1
            if combo is None:
                break
            kinds, each = np.unique((n, *combo), return_counts=True)
            times = int((have[kinds] // each).min())
            have[kinds] -= each * times
            done.append(((n, *combo), times))
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    room = np.zeros(capacity + 1, np.int64)

    def put(shape: tuple[int, ...], times: int) -> None:
        left = capacity - sum(shape)
        bins.setdefault(left, []).append((shape, times))
        room[left] += times

    for n in range(capacity, 0, -1):
        left = int(have[n])
        while left:
            fits = np.flatnonzero(room[n:])
            if len(fits):
                r = n + int(fits[0])
                shape, times = bins[r].pop()
                room[r] -= times
                use = min(left, times)
                put((*shape, n), use)
                if times > use:
                    put(shape, times - use)
                left -= use
            else:
                each = capacity // n
                full, rest = divmod(left, each)
                if full:
                    put((n,) * each, full)
                if rest:
                    put((n,) * rest, 1)
                left = 0
    return done + [x for r in sorted(bins) for x in bins[r]]


def slots(shapes: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by (length, first rank): how many a sequence holds, their offsets, the first sequence's number."""
    used: dict[int, int] = {}
    rows: list[tuple[int, int, int, int]] = []
    offsets: list[int] = []
    first = 0
    for shape, times in shapes:
        at, places = 0, {}
        for n in shape:
            places.setdefault(n, []).append(at)
            at += n
        for n, where in places.items():
            rows.append(((n << 40) + used.get(n, 0), len(where), len(offsets), first))
            used[n] = used.get(n, 0) + len(where) * times
            offsets += where
        first += times
    key, each, at, seq = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return {"key": key, "each": each, "at": at, "seq": seq, "offsets": np.array(offsets, np.int64)}


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32; read three times, so stage them) with sequence_id and offset."""
    spark = parts.sparkSession
    # one row a length: at most ``capacity``
    counts = {int(r["length"]): int(r["count"]) for r in parts.groupBy("length").count().collect()}
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    if not counts:
        return spark.createDataFrame([], schema)
    table = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    span = min(20_000, max(64, sum(counts.values()) // 1000))
    buckets = F.array(*[F.lit(-(-counts.get(n, 0) // span) or 1) for n in range(capacity + 1)])
    keyed = parts.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(buckets, F.col("length").cast("int"))))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = keyed.groupBy("length", "_b").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("_n", F.row_number().over(inside) - 1).join(start, ["length", "_b"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_n") + F.col("_before")).alias("_rank"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = table.value
        for f in frames:
            key = (f["length"].to_numpy() << 40) + f.pop("_rank").to_numpy()
            k = np.searchsorted(t["key"], key, "right") - 1
            nth, slot = np.divmod(key - t["key"][k], t["each"][k])
            yield f.assign(sequence_id=t["seq"][k] + nth, offset=t["offsets"][t["at"][k] + slot])

    return ranked.mapInPandas(place, schema)


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    """Pieces of ``docs`` with their places."""
    return pack(stage_table(pieces(docs, **how), "pieces"))
