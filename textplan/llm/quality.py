"""A quality classifier by Bradley-Terry pairwise ranking.

Each document has a score s(x) = w.f(x) over features of its whole text. A
pair of a good and a bad document is a preference, won with probability
1 / (1 + exp(s(bad) - s(good))); w minimises the logistic loss on feature
differences. Scores then become numbers from 0 to 1 by a logistic curve that
passes `cut` at a quantile of the training scores: the share of documents
labelled 0, so that as many are rejected as were labelled bad.

Scale: features are computed where the text is read, in batches of arrays, and
each document is scored in the same pass. Training reads at most SAMPLE
labelled documents, the first by a hash of their id (documented bound; a few
MB of features reach the driver), and PAIRS pairs of them drawn with a seed.

Defined results: null and empty texts have the features of an empty text and
get a score like any other; ids may be null (held_out is then null, and such
rows are scored) or repeat; a labelled id whose labels disagree evenly is left
out of training; without both labels every score is `cut`; other columns are
carried unless named like a result column; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._text import NOT_SPACE, Words, flat, pieces

SAMPLE, PAIRS, SEED = 20_000, 200_000, 5
RESULT = ("held_out", "score", "predicted")

#: Classes of bytes whose shares are features.
CLASSES: list[bytes] = [
    bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), bytes(range(128, 256)), b" ", b"\n", b".", b",", b"!?", b"$#%&*~^=+_", b"|", b"<>{}[]()", b":;/@\\", b"'\"-",
]
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False


def _shares_of_repeats(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By text: share of values that are not the first of their kind, and share of the commonest."""
    n = np.diff(of)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, text))
    t, v = text[order], h[order]
    first = np.ones(len(v), dtype=bool)
    first[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(first)
    size = np.diff(np.r_[at, len(v)])
    kinds = np.bincount(t[at], minlength=len(n)) if len(v) else np.zeros(len(n))
    most = np.zeros(len(n))
    np.maximum.at(most, t[at], size)
    return 1 - kinds / np.maximum(n, 1) * (n > 0) - (n == 0), most / np.maximum(n, 1)


def features(column) -> np.ndarray:
    """A row of numbers for each text."""
    buf, offsets = flat(column)
    n = np.diff(offsets).astype(float)
    some = np.maximum(n, 1)

    def per_text(x: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(x, dtype=np.int64)]
        return sums[offsets[1:]] - sums[offsets[:-1]]

    out = [np.log1p(n)]
    table = np.zeros(256, dtype=np.uint8)
    for i, c in enumerate(CLASSES):
        table[list(c)] = i + 1
    kind = table[buf]
    shares = [per_text(kind == i + 1) / some for i in range(len(CLASSES))]
    out += shares + [np.sqrt(s) for s in shares]
    w = Words(buf, offsets, NOT_SPACE, lower=True)
    words = np.diff(w.of)
    length = (w.end - w.start).astype(float)
    sums = np.r_[0, np.cumsum(length)]
    squares = np.r_[0, np.cumsum(length**2)]
    mean = (sums[w.of[1:]] - sums[w.of[:-1]]) / np.maximum(words, 1)
    out += [np.log1p(words), mean, np.sqrt(np.maximum((squares[w.of[1:]] - squares[w.of[:-1]]) / np.maximum(words, 1) - mean**2, 0))]
    again, most = _shares_of_repeats(w.hash, w.of)
    out += [again, most, again * np.log1p(words)]
    lines = Words(buf, offsets, _LINE, lower=False)
    again, most = _shares_of_repeats(lines.hash, lines.of)
    out += [np.log1p(np.diff(lines.of)), again, most * (np.diff(lines.of) > 1), words / np.maximum(np.diff(lines.of), 1) / 100]
    # Shares of words that end in a letter, and that repeat the word before.
    ends = np.r_[0, np.cumsum(((buf[w.end - 1] | 32) >= 97) & ((buf[w.end - 1] | 32) <= 122) | (buf[w.end - 1] >= 128))] if len(w) else np.zeros(1)
    out.append((ends[w.of[1:]] - ends[w.of[:-1]]) / np.maximum(words, 1))
    return np.stack(out, 1)


class Ranker:
    """Standardised features, their weights, and the curve from ranks to scores."""

    def __init__(self, mean, scale, weights, middle, steep, cut):
        self.mean, self.scale, self.weights, self.middle, self.steep, self.cut = mean, scale, weights, middle, steep, cut

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-6, 6)
        out = np.zeros(len(x))
        for j, w in enumerate(self.weights):  # in one order, so that a score does not depend on a batch's size
            out += z[:, j] * w
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.steep * (self.raw(x) - self.middle) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-z.clip(-50, 50)))


def fit(x: np.ndarray, y: np.ndarray, cut: float = 0.7, pairs: int = PAIRS, ridge: float = 1e-4, seed: int = SEED) -> Ranker:
    """Learn weights from pairs by Newton's method on the pairwise logistic loss."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    width = x.shape[1] if x.ndim == 2 else 1
    if not len(good) or not len(bad):
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.0, cut)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = ((x - mean) / scale).clip(-6, 6)
    r = np.random.default_rng(seed)
    d = z[r.choice(good, pairs)] - z[r.choice(bad, pairs)]
    w = np.zeros(width)
    for _ in range(30):
        p = 1 / (1 + np.exp((d @ w).clip(-40, 40)))  # chance that the pair is lost
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(width), d.T @ p / pairs - ridge * w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    # The quantile itself lies beside one document; midway between its neighbourhoods is steadier.
    share = len(bad) / len(y)
    middle = float(np.quantile(s, [share * 0.995, share + (1 - share) * 0.005]).mean())
    # Steepness by the likelihood of the labels around that quantile.
    at = (s - middle)[:, None] * np.geomspace(0.05, 5, 40)[None, :] + np.log(cut / (1 - cut))
    loss = (np.logaddexp(0, -at) * (y[:, None] == 1) + np.logaddexp(0, at) * (y[:, None] == 0)).mean(0)
    return Ranker(mean, scale, w, middle, float(np.geomspace(0.05, 5, 40)[loss.argmin()]), cut)


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker:
    """Fit on at most SAMPLE labelled documents that aren't held out; of rows with one id, one."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(label_col).alias("y")).where("y <> 0.5")
    known = known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", F.round("y").cast("int").alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = features(b["text"])
            yield pa.RecordBatch.from_arrays([b["id"], b["y"], pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    # One row of each id (the least features), so that the sample stays bounded where rows repeat an id.
    rows = texts.join(F.broadcast(known), "id").mapInArrow(go, "id long, y int, x array<double>").groupBy("id", "y").agg(F.min("x").alias("x")).toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, 1)), np.zeros(0), cut)
    x = np.stack(rows["x"].to_numpy())
    y = rows["y"].to_numpy()
    order = np.lexsort((*x.T, y, rows["id"].to_numpy()))  # rows come in any order
    return fit(x[order], y[order], cut)


def _apply(ranker: Ranker, names: list[str]):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = features(b["text"])
            score = ranker.score(x if x.shape[1] == len(ranker.mean) else np.zeros((len(x), 1)))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in b.schema.names), pa.array(score), pa.array((score >= ranker.cut).astype(np.int32))], names=names)

    return go


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Score every document's whole text.

    Returns the columns of `docs` and held_out, score and predicted (1 if the
    score is `cut` or more).
    """
    ranker = train(docs, labels, cut, id_col, text_col, label_col)
    carry = [c for c in docs.columns if c not in RESULT]
    rest = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry if c != text_col], F.lit(0).alias("_")).alias("rest"), F.col(text_col).cast("string").alias("text"))
    schema = StructType(rest.schema.fields + StructType.fromDDL("score double, predicted int").fields)
    out = rest.mapInArrow(_apply(ranker, schema.names), schema)
    columns = [F.col("text").alias(text_col) if c == text_col else F.col(f"rest.`{c}`") for c in carry]
    return out.select(*columns, held_out(F.col(f"rest.`{id_col}`")).alias("held_out"), "score", "predicted")
