"""Quality classifier (operator 10).

Method: Bradley-Terry pairwise ranking.  P(i before j) = sigmoid(w . (x_i - x_j)) over
preference pairs of a labelled 1 and a labelled 0; w by Newton steps on the logistic loss of
feature differences.  The threshold is a quantile of the scores: the share of 0 among the
labels.  Scores are shifted so that this quantile stands at THRESHOLD.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memstore.llm.common import fields, kept_columns, numbered, prefix_hash, slices, span_hash, tidy, utf8

#: Bounds of the learning sample, in labelled rows, and of its preference pairs.
SAMPLE_ROWS, PAIRS = 20_000, 60_000
THRESHOLD = 0.3
FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "exclaim", "other_punct", "distinct", "adjacent", "top_word", "dup_lines", "line_words", "no_stop")

_CLASS = np.zeros((256, 8), bool)
for _b in b" \t\n\x0b\x0c\r":
    _CLASS[_b, 0] = True
for _b in b"#*$%&|<>":
    _CLASS[_b, 1] = True
_CLASS[65:91, 2] = True
_CLASS[97:123, 3] = True
_CLASS[48:58, 4] = True
_CLASS[ord("!"), 5] = True
for _b in b"\"'(),-./:;=?@[]_`{}~+^\\":
    _CLASS[_b, 6] = True
_CLASS[0x80:0xC0, 7] = True


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The features of each text, as rows; data, off: bytes and offsets.  An empty text gets zeros."""
    n = len(off) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), np.diff(off))
    per = lambda mask: np.bincount(doc[mask], minlength=n)
    kinds = [_CLASS[:, k][data] for k in range(8)]
    space = kinds[0]
    count = [per(k) for k in kinds]
    chars = np.maximum(np.diff(off) - count[7], 1)
    solid = np.maximum(chars - count[0], 1)
    edge = np.zeros(len(data) + 1, bool)
    edge[off[:-1][off[:-1] < len(data)]] = True
    before = np.append(True, space[:-1])
    start = np.flatnonzero(~space & (before | edge[:-1]))
    stop_mask = ~space & (np.append(space[1:], True) | edge[1:])
    stop_mask[-1] |= not space[-1]
    stop = np.flatnonzero(stop_mask) + 1
    word = span_hash(prefix_hash(data), start, stop)
    owner = doc[start]
    words = np.bincount(owner, minlength=n)
    some = np.maximum(words, 1)
    same = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((word, owner))
    w, o = word[order], owner[order]
    fresh = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (o[1:] != o[:-1]))) if len(w) else np.zeros(0, int)
    runs = np.diff(np.append(fresh, len(w)))
    top = np.zeros(n)
    np.maximum.at(top, o[fresh], runs)
    distinct = np.bincount(o[fresh], minlength=n)
    newline = data == 10
    lines = per(newline) + 1
    ls = np.flatnonzero(np.append(True, newline[:-1]) | edge[:-1])
    le = np.append(ls[1:], len(data))
    le = le - (newline[le - 1] & (le > ls))
    line = span_hash(prefix_hash(data), ls, np.maximum(le, ls))
    lo = doc[ls]
    full = le > ls
    lorder = np.lexsort((line[full], lo[full]))
    l2, o2 = line[full][lorder], lo[full][lorder]
    dup = (l2[1:] == l2[:-1]) & (o2[1:] == o2[:-1])
    has = words > 0
    out[:, 0] = np.log1p(words)
    out[:, 1] = np.minimum(solid / some, 40) * has
    out[:, 2] = np.log1p(50 * count[1] / solid)
    out[:, 3] = np.log1p(20 * count[2] / np.maximum(count[2] + count[3], 1))
    out[:, 4] = np.log1p(20 * count[4] / solid)
    out[:, 5] = np.log1p(50 * count[5] / solid)
    out[:, 6] = np.log1p(20 * count[6] / solid)
    out[:, 7] = distinct / some
    out[:, 8] = np.log1p(50 * np.bincount(owner[1:][same], minlength=n) / some)
    out[:, 9] = top / some
    out[:, 10] = np.log1p(20 * np.bincount(o2[1:][dup], minlength=n) / lines)
    out[:, 11] = np.log1p(words / lines)
    out[:, 12] = np.log1p(words) < np.log1p(10)
    return out


def featured(batches, columns: int):
    """(other columns, feature rows) of each slice of Arrow batches whose last column is the text."""
    for batch in batches:
        for part in slices(batch, columns, 2_000_000):
            data, off = utf8(part.column(columns))
            yield part, features(data, off)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, __y, text) of at most `rows` labelled documents: those of least id hash, each id once.

    Of an id that repeats, the least label and the least text count, so no input makes the
    sample larger.  Only the sample of ids and labels is broadcast, `rows` rows at most."""
    own, label = F.col(f"`{id_col}`"), F.col(f"`{label_col}`")
    some = labels.where(label.isNotNull() & own.isNotNull()).groupBy(own.alias("__id")).agg(F.min(label.cast("double")).alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    held = docs.select(own.alias("__id"), F.col(f"`{text_col}`").alias("__text")).join(F.broadcast(some), "__id")
    return held.groupBy("__id", "__y").agg(F.min("__text").alias("__text")).select(F.col("__id").alias(id_col), "__y", F.col("__text").alias(text_col))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """The model, or None where the labels don't hold both 0 and 1."""

    def run(batches):
        for part, x in featured(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    got = labelled_sample(docs, labels, label_col, id_col, text_col).select("__y", F.col(f"`{text_col}`").alias("text")).mapInArrow(tidy(run), "y double, x array<double>").collect()
    got.sort(key=lambda r: (r["y"], r["x"]))
    y = np.array([r["y"] for r in got])
    if not (y == 1).any() or not (y == 0).any():
        return None
    raw = np.array([r["x"] for r in got])
    mean, scale = raw.mean(axis=0), raw.std(axis=0) + 1e-6
    x = (raw - mean) / scale
    rng = np.random.default_rng(5)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    diff = x[rng.choice(good, PAIRS)] - x[rng.choice(bad, PAIRS)]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        grad = diff.T @ (1 - p) / PAIRS - 1e-3 * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / PAIRS + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    cut = float(np.quantile(x @ w, (y == 0).mean()))
    return {"mean": mean, "scale": scale, "w": w, "shift": float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)}


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """id, the columns of `keep`, score (0 to 1), predicted (1 if score >= THRESHOLD).

    A null text scores as an empty one.  Without a model every score is 0.5.  Rows are
    independent, so repeated rows and null ids come back as they are.  Columns of `keep` that
    are named like a result are left out.
    """
    keep = kept_columns(keep, [id_col, "score", "predicted"])

    def run(batches):
        for part, x in featured(batches, 1 + len(keep)):
            if model is None:
                s = np.full(len(x), 0.5)
            else:
                s = 1 / (1 + np.exp(-np.clip((x - model["mean"]) / model["scale"] @ model["w"] + model["shift"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*part.columns[: 1 + len(keep)], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[id_col, *keep, "score", "predicted"])

    used = docs.select(*numbered([id_col, *keep, text_col]))
    return used.mapInArrow(tidy(run), ", ".join([*fields(docs.schema, [id_col, *keep]), "score double", "predicted int"]))
