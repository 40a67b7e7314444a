"""Language identification by string kernels.

A text is the set of its character n-grams of ``ORDERS`` lengths (the blended
spectrum), hashed to ``DIMS`` places. The presence kernel of two texts is the
number of n-grams that both have over the geometric mean of their numbers.
Landmark texts give Nyström features, K_mm^(-1/2) k(x), on which one-versus-rest
kernel ridge regression is fitted; ridge weights and landmarks fold into one
matrix of DIMS x languages, so a batch of texts is scored by one product of its
presence matrix with it.

Fitting takes a bounded sample: about ``per_language`` labelled texts of every
language there is, chosen by a hash of the id, each collected as a bit set of DIMS bits.

A text that is null, empty or without any letter is ``und`` with score 0. Ties
go to the language that sorts first. Whole texts are read; case is folded, and
digits, signs and white space all count as one word boundary. Repeated rows get a
row each; an empty table gives an empty result and a model without languages, under
which every text is ``und``. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, map_texts, trim

ORDERS = (1, 2, 3, 4)
DIMS = 1 << 15
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]")
#: Turns differences of ridge scores into shares; scores lie about 0 and 1.
SHARPNESS = 12.0
BATCH = 64
#: Landmarks a language has at least, if it has as many texts.
LEAST = 3

_FOLD: np.ndarray | None = None


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter; numbers that are no decimal digits, as in fractions and exponents, are none."""
    return bool(text) and any(m[0].isalpha() for m in _WORD.finditer(text))


def _fold() -> np.ndarray:
    """Code point -> that of its lower case, or 32 where it is no letter, up to U+FFFF."""
    global _FOLD
    if _FOLD is None:
        table = np.full(1 << 16, 32, np.uint32)
        for c in range(1 << 16):
            ch = chr(c)
            if ch.isalpha() or 0x300 <= c < 0x370:
                table[c] = ord(ch.lower()[0])
        _FOLD = table
    return _FOLD


def present(text: str) -> np.ndarray:
    """The places of a text's n-grams, each once, in order."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(code < 1 << 16, _fold()[np.minimum(code, 0xFFFF)], code)
    code = np.r_[np.uint32(32), code, np.uint32(32)]
    code = code[np.r_[True, (code[1:] != 32) | (code[:-1] != 32)]]
    seen = np.zeros(DIMS, bool)
    h = np.zeros(len(code), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(code) < n:
            break
        h = (h[: len(code) - n + 1] + code[n - 1 :]) * np.uint32(0x9E3779B1)
        if n in ORDERS:
            seen[((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(17)] = True
        h ^= h >> np.uint32(13)
    return np.flatnonzero(seen)


@dataclass
class LanguageModel:
    languages: list[str]
    #: DIMS x languages: landmarks' n-grams times their kernel ridge weights.
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        rows = np.zeros((BATCH, DIMS), np.float32)
        for k in range(0, len(at), BATCH):
            part = at[k : k + BATCH]
            found = [present(texts[i]) for i in part]
            for row, places in zip(rows, found, strict=False):
                row[places] = 1
            size = np.sqrt(np.array([len(p) for p in found], np.float32))
            out = rows[: len(part)] @ self.weights / size[:, None] + self.bias
            for row, places in zip(rows, found, strict=False):
                row[places] = 0
            share = np.exp(SHARPNESS * (out - out.max(1, keepdims=True)))
            share /= share.sum(1, keepdims=True)
            for i, j, s in zip(part, share.argmax(1).tolist(), share.max(1).tolist(), strict=True):
                names[i], scores[i] = self.languages[j], s
        return names, scores


def fit(bits: np.ndarray, labels: list[str], landmarks: int = 192, ridge: float = 0.3) -> LanguageModel:
    """From presence rows (n x DIMS, booleans) and their languages; landmarks are dealt out over the languages, ``LEAST`` to each at least."""
    languages = sorted(set(labels))
    landmarks = max(landmarks, LEAST * len(languages))
    if not languages:
        return LanguageModel([], np.zeros((DIMS, 0), np.float32), np.zeros(0, np.float32))

    def unit(rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float32)
        x /= np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))
        return x

    y = np.array([[lang == one for one in languages] for lang in labels], np.float64)
    turn: dict[str, int] = {}
    order = []
    for i, lang in enumerate(labels):
        turn[lang] = turn.get(lang, -1) + 1
        order.append((turn[lang], i))
    chosen = unit(bits[[i for _, i in sorted(order)[:landmarks]]])
    value, vector = np.linalg.eigh((chosen @ chosen.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    # few rows at a time: a row is 4 bytes a dimension here
    z = np.concatenate([(unit(bits[i : i + 64]) @ chosen.T).astype(np.float64) @ root for i in range(0, len(bits), 64)])
    # every language weighs the same, however many texts of it the sample has
    w = (1.0 / (y.sum(0) * len(languages)))[y.argmax(1)] * len(y)
    mean, middle = (w[:, None] * z).sum(0) / w.sum(), (w[:, None] * y).sum(0) / w.sum()
    zc = z - mean
    beta = np.linalg.solve((zc * w[:, None]).T @ zc + ridge * np.eye(z.shape[1]), (zc * w[:, None]).T @ (y - middle))
    return LanguageModel(languages, (chosen.T.astype(np.float64) @ (root @ beta)).astype(np.float32), (middle - mean @ beta).astype(np.float32))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _draw(id_col: Column) -> Column:
    return F.pmod(F.xxhash64(id_col, F.lit("langid")), F.lit(1 << 30))


def train(docs: DataFrame, per_language: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 25_600) -> LanguageModel:
    """Fit on about ``per_language`` texts of each language, held-out ids left out; on fewer of each, though one at least, where that makes more than ``most``.

    Every language with a lettered text is learned. Ids are chosen from ids and labels alone; rows travel as DIMS bits each.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    lettered = known.filter(F.col(text_col).rlike(r"\p{L}"))
    counts = lettered.groupBy(lang_col).agg(F.count("*").alias("n"), F.min(_draw(F.col(id_col))).alias("least")).collect()
    if not counts:
        return fit(np.zeros((0, DIMS), bool), [])
    per_language = min(per_language, max(1, most // len(counts)))
    # the text of the least draw is always in
    rate = {r[0]: max(min(1.0, per_language / r[1]) * (1 << 30), r[2] + 1.0) for r in counts}
    keep = F.create_map(*[F.lit(x) for pair in rate.items() for x in pair])
    sample = lettered.filter(_draw(F.col(id_col)) < F.try_element_at(keep, F.col(lang_col)))

    def kernel():
        def step(batch: pa.RecordBatch) -> dict | None:
            rows = [(i, lang, t) for i, lang, t in zip(column(batch, id_col), column(batch, lang_col), column(batch, text_col), strict=True) if has_letter(t)]
            bits = []
            for _, _, t in rows:
                row = np.zeros(DIMS, bool)
                row[present(t)] = True
                bits.append(np.packbits(row).tobytes())
            return {"id": [r[0] for r in rows], "lang": [r[1] for r in rows], "bits": bits}

        return step

    bits = map_texts(sample.select(id_col, lang_col, text_col), kernel, "id long, lang string, bits binary", text_col)
    # rows without ids, or of one id, have one draw: bounded within their language, so that no other goes without
    place = F.row_number().over(Window.partitionBy("lang").orderBy(_draw(F.col("id")), "id", "bits"))
    bits = bits.withColumn("place", place).filter(F.col("place") <= 2 * per_language)
    rows = sorted(bits.collect(), key=lambda r: (r["id"] is None, r["id"] or 0, r["bits"]))
    packed = np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint8).reshape(len(rows), DIMS // 8)
    model = fit(np.unpackbits(packed, axis=1).view(bool), [r["lang"] for r in rows])
    trim()  # the driver's memory, too
    return model


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel():
        m = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            names, scores = m.predict(column(batch, text_col))
            return {"doc_id": column(batch, id_col), "held_out": column(batch, "held_out"), "lang_pred": names, "score": scores}

        return step

    rows = docs.select(id_col, text_col, held_out(F.col(id_col)).alias("held_out"))
    return map_texts(rows, kernel, "doc_id long, held_out boolean, lang_pred string, score double", text_col)


def determined(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang", sure: float | None = None) -> DataFrame:
    """``docs`` whose language can be told, with all their columns: a text without any letter goes.

    A document without a language gets the one predicted for its text, if any was learned. One that bears a language keeps it, unless
    ``sure`` is given: then another language that is predicted with that score at least takes the place of one that was learned, too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel():
        m = shared.value
        learned = set(m.languages)

        def step(batch: pa.RecordBatch) -> dict | None:
            kept = batch.filter(pa.array([has_letter(t) for t in column(batch, text_col)], pa.bool_()))
            if not kept.num_rows:
                return None
            cols = {n: kept.column(i) for i, n in enumerate(kept.schema.names)}
            langs = column(kept, lang_col)
            asked = [i for i, x in enumerate(langs) if x is None or (sure is not None and x in learned)]
            if asked and learned:
                texts = column(kept, text_col)
                for i, name, score in zip(asked, *m.predict([texts[i] for i in asked]), strict=True):
                    if langs[i] is None or score >= sure:
                        langs[i] = name
                cols[lang_col] = pa.array(langs, kept.schema.field(lang_col).type)
            return cols

        return step

    return map_texts(docs, kernel, docs.schema, text_col)
