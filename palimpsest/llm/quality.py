"""Document quality from a linear-chain conditional random field over lines.

Each line has counts of byte classes, its length, words, repetition and ends as
features, and those of both neighbours besides. The field has two labels (bad,
good) with transition weights; forward and backward passes give each line's
marginal, and the marginals weighted by the lines' lengths give the document's
share of good text, which a logistic curve turns into the score.

Only documents are labelled, so lines' labels are latent: a line agrees with its
document's label with the odds e^(2 ``EVIDENCE``), whatever else its features
and its neighbours say. Fitting starts from lines that bear their document's
label and then takes, in turn, the lines' marginals given that evidence for what
was seen, so that changes of label within a document are learned as transitions.
It takes a bounded sample of labelled documents: about ``per_class`` of each
label, chosen by a hash of the id, of at most ``max_lines`` lines each. Scoring
reads whole texts.

Null and empty texts, and texts of empty lines only, have no lines and get the
share of label 1 among the sample. Without any labels every score is 0.5. Repeated
rows get a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, map_texts

#: How strongly a document's label speaks for each line's, and rounds of fitting before lines may differ from it.
EVIDENCE, WARM = 1.5, 60
THRESHOLD = 0.3
LOWER, UPPER, DIGIT, BLANK, STOP, BAR, SHOUT, SIGN, TAIL, CONTROL = range(10)
CLASSES = 10


def _classes() -> np.ndarray:
    t = np.full(256, CONTROL, np.uint8)
    t[ord("a") : ord("z") + 1] = LOWER
    t[ord("A") : ord("Z") + 1] = UPPER
    t[ord("0") : ord("9") + 1] = DIGIT
    t[[32, 9, 13]] = BLANK
    for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
        t[ord(c)] = STOP if c in ".,;:'\"-()?" else BAR if c == "|" else SHOUT if c == "!" else SIGN
    t[0x80:0xC0] = TAIL
    t[0xC0:] = LOWER
    return t


_CLASS = _classes()
FEATURES = 20


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features of every line that isn't empty, their lengths in bytes, lines of each text)."""
    lines: list[bytes] = []
    per, seen_before, again = np.zeros(len(texts), np.int64), [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        own = [x for x in t.encode().split(b"\n") if x]
        per[i] = len(own)
        seen: set[bytes] = set()
        for x in own:
            seen_before.append(x in seen)
            seen.add(x)
            tokens = x.split()
            again.append(1 - len(set(tokens)) / len(tokens) if tokens else 0.0)
        lines += own
    if not lines:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0), per
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    flat = np.frombuffer(b"".join(lines), np.uint8)
    kind = _CLASS[flat]
    start = np.r_[0, np.cumsum(size)[:-1]]
    row = np.repeat(np.arange(len(lines), dtype=np.int32), size)
    count = np.bincount(row * CLASSES + kind, minlength=CLASSES * len(lines)).reshape(-1, CLASSES).astype(np.float64)
    chars = np.maximum(1, size - count[:, TAIL])
    first = np.zeros(len(flat), bool)
    first[start] = True
    filled = kind != BLANK
    begins = filled & (first | np.r_[True, ~filled[:-1]])
    words = np.maximum(1, np.bincount(row[begins], minlength=len(lines)))
    twin = np.r_[False, flat[1:] == flat[:-1]] & ~first & (kind >= STOP) & (kind <= SIGN)
    twins = np.bincount(row[twin], minlength=len(lines))
    letters = np.maximum(1, count[:, LOWER] + count[:, UPPER])
    last = kind[start + size - 1]
    x = np.zeros((len(lines), FEATURES), np.float32)
    for j, c in enumerate((LOWER, UPPER, DIGIT, BLANK, STOP, BAR, SHOUT, SIGN)):
        x[:, j] = count[:, c] / chars
    x[:, 8] = np.log1p(size) / 5
    x[:, 9] = (chars - count[:, BLANK]) / words / 10
    x[:, 10] = seen_before
    x[:, 11] = count[:, UPPER] / letters > 0.6
    x[:, 12] = last == STOP
    x[:, 13] = kind[start] == UPPER
    x[:, 14] = twins / chars
    x[:, 15] = words < 4
    x[:, 16] = count[:, SIGN] + count[:, BAR] + count[:, SHOUT] > 0
    repeats = np.array(again)
    x[:, 17] = repeats
    x[:, 18] = (repeats > 0.6) & (words > 8)
    x[:, 19] = (repeats > 0.85) & (words > 12)
    return x, size.astype(np.float64), per


def with_neighbours(x: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after in the same text (zeros at its ends), and a constant."""
    n = len(x)
    doc = np.repeat(np.arange(len(per)), per)
    same = doc[1:] == doc[:-1] if n else np.zeros(0, bool)
    out = np.zeros((n, 3 * FEATURES + 3), np.float32)
    out[:, :FEATURES] = x
    out[1:, FEATURES : 2 * FEATURES] = x[:-1] * same[:, None]
    out[:-1, 2 * FEATURES : 3 * FEATURES] = x[1:] * same[:, None]
    out[1:, -3], out[:-1, -2], out[:, -1] = same, same, 1
    return out


def _steps(per: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Texts by falling number of lines, where each one's lines begin, and how many have a t-th line."""
    order = np.argsort(-per, kind="stable")
    starts = (np.cumsum(per) - per)[order]
    live = np.searchsorted(-per[order], -np.arange(per.max(initial=0)), "left")
    return order, starts, live.tolist()


def forward_backward(score: np.ndarray, trans: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginal of label 1 of each line, summed pair marginals 2 x 2, sum of log partition functions).

    ``score`` are the lines' emissions of label 1 over label 0; a pass goes line by line over all texts at once.
    """
    n = len(score)
    emit = np.stack([np.zeros(n), score], 1)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    _, starts, live = _steps(per)
    for t, k in enumerate(live):
        at = starts[:k] + t
        if t == 0:
            alpha[at] = emit[at]
        else:
            p = alpha[at - 1]
            alpha[at] = np.logaddexp(p[:, :1] + trans[0], p[:, 1:] + trans[1]) + emit[at]
    for t in range(len(live) - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        q = beta[at + 1] + emit[at + 1]
        beta[at] = np.logaddexp(trans[:, 0] + q[:, :1], trans[:, 1] + q[:, 1:])
    both = alpha + beta
    z = np.logaddexp(both[:, 0], both[:, 1])
    marginal = np.exp(both[:, 1] - z)
    inner = np.ones(n, bool)
    inner[starts[: live[0]] if live else []] = False
    at = np.flatnonzero(inner)
    pair = np.exp(alpha[at - 1][:, :, None] + trans + (emit[at] + beta[at])[:, None, :] - z[at][:, None, None]).sum(0)
    heads = starts[: live[0]] if live else np.zeros(0, np.int64)
    return marginal, pair, float(z[heads].sum())


@dataclass
class QualityModel:
    weights: np.ndarray
    trans: np.ndarray
    curve: tuple[float, float]
    prior: float

    def good_share(self, x: np.ndarray, size: np.ndarray, per: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals; NaN for texts without lines."""
        marginal = forward_backward(with_neighbours(x, per) @ self.weights, self.trans, per)[0]
        doc = np.repeat(np.arange(len(per)), per)
        total = np.bincount(doc, size, len(per))
        with np.errstate(invalid="ignore"):
            return np.bincount(doc, size * marginal, len(per)) / total

    def score(self, texts: list[str | None]) -> np.ndarray:
        share = self.good_share(*line_features(texts))
        a, b = self.curve
        p = np.clip(share, 1e-6, 1 - 1e-6)
        return np.where(np.isnan(share), self.prior, 1 / (1 + np.exp(-(a * np.log(p / (1 - p)) + b))))


def fit(x: np.ndarray, size: np.ndarray, per: np.ndarray, label: np.ndarray, true_share: float | None = None, rounds: int = 200, ridge: float = 2e-3) -> QualityModel:
    """Maximum likelihood with a ridge, by Adam over all lines; classes weigh the same, then the curve restores ``true_share``."""
    if not len(per):
        return QualityModel(np.zeros(3 * FEATURES + 3), np.zeros((2, 2)), (0.0, 0.0), 0.5)
    true_share = float(label.mean()) if true_share is None else true_share
    full = with_neighbours(x, per).astype(np.float64)
    y = np.repeat(label, per).astype(np.float64)
    doc = np.repeat(np.arange(len(per)), per)
    later = np.r_[False, doc[1:] == doc[:-1]]
    lines, seen = y, np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = (later & (y == k)).sum()
    w, trans = np.zeros(full.shape[1]), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(trans)]
    v = [np.zeros_like(w), np.zeros_like(trans)]
    for t in range(1, rounds + 1):
        if t > WARM and t % 10 == 1:
            lines, seen, _ = forward_backward(full @ w + EVIDENCE * (2 * y - 1), trans, per)
        marginal, pair, _ = forward_backward(full @ w, trans, per)
        grads = [full.T @ (marginal - lines) / len(y) + ridge * w, (pair - seen) / len(y) + 10 * ridge * trans]
        for k, (value, g) in enumerate(zip((w, trans), grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            value -= 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    model = QualityModel(w, trans, (1.0, 0.0), true_share)
    share = model.good_share(x, size, per)
    some = ~np.isnan(share)
    p = np.clip(share[some], 1e-6, 1 - 1e-6)
    z, target = np.log(p / (1 - p)), label[some].astype(np.float64)
    weight = np.where(target == 1, true_share / max(label.mean(), 1e-9), (1 - true_share) / max(1 - label.mean(), 1e-9))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic curve in one variable, held near slope 1 by a weak prior
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, h = weight * (q - target), weight * q * (1 - q) + 1e-9
        hess = np.array([[(h * z * z).sum() + 1, (h * z).sum()], [(h * z).sum(), h.sum() + 1]])
        step = np.linalg.solve(hess, [(r * z).sum() + (a - 1), r.sum() + b])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.curve = (float(a), float(b))
    return model


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_lines: int = 2000) -> QualityModel:
    """Fit on about ``per_class`` labelled documents of each class, of ``max_lines`` lines at most; held-out ids left out, several labels of an id count as the least."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    counts = {int(r[0]): r[1] for r in known.groupBy("label").count().collect()}
    if not counts:
        return fit(np.zeros((0, FEATURES)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
    coin = F.pmod(F.xxhash64(F.col("id"), F.lit("quality")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("label") == 1, min(1.0, per_class / counts.get(1, 1))).otherwise(min(1.0, per_class / counts.get(0, 1)))
    # two classes of about per_class ids: small whatever the corpus
    sample = known.filter(coin < rate).orderBy(coin, "id").limit(4 * per_class)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def kernel():
        def step(batch: pa.RecordBatch) -> dict | None:
            out: dict[str, list] = {k: [] for k in ("id", "label", "x", "size")}
            for i, label, t in zip(column(batch, "id"), column(batch, "label"), column(batch, "text"), strict=True):
                x, size, per = line_features([t])
                if 0 < per[0] <= max_lines:
                    for k, v in zip(out, (i, label, x.tobytes(), size.tobytes()), strict=True):
                        out[k].append(v)
            return out

        return step

    got = map_texts(rows, kernel, "id long, label int, x binary, size binary").orderBy("id", F.xxhash64("x")).limit(4 * per_class).collect()
    got.sort(key=lambda r: (r["id"], bytes(r["x"])))
    size = [np.frombuffer(bytes(r["size"])) for r in got]
    x = [np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, FEATURES) for r in got]
    if not got:
        return fit(np.zeros((0, FEATURES)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
    share = counts.get(1, 0) / sum(counts.values())
    return fit(np.concatenate(x), np.concatenate(size), np.array([len(s) for s in size]), np.array([r["label"] for r in got]), share)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel():
        m = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            s = m.score(column(batch, text_col))
            return {"doc_id": column(batch, id_col), "held_out": column(batch, "held_out"), "score": s.tolist(), "predicted": (s >= threshold).astype(int).tolist()}

        return step

    rows = docs.select(id_col, text_col, held_out(F.col(id_col)).alias("held_out"))
    return map_texts(rows, kernel, "doc_id long, held_out boolean, score double, predicted int", text_col)
