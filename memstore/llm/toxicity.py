"""Toxicity (operator 7).

Method: a classifier chain.  Categories are predicted one after the other by logistic models
over term features; each model also gets the probabilities of the categories before it, and
learns from out-of-fold ones, so that it meets in learning what it meets in use.

`labels` has one toxicity column, so the categories before the last are learned from it: the
terms that speak for toxicity are gathered into GROUPS groups by the documents that hold them,
and a document belongs to a category where it is toxic and holds a term of its group.  The last
link is `toxic` itself; it sees the other links' probabilities beside the terms.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memstore.llm.common import Scratch, fields, kept_columns, numbered, tidy
from memstore.llm.quality import labelled_sample

#: Bound of the learning sample in labelled rows, terms of the model, folds.
SAMPLE_ROWS, TERMS, FOLDS = 20_000, 400, 5
#: Least sample documents that hold a term, least log-likelihood ratio of a term.
MIN_DOCS, LEAST_RATIO = 4, 15.0
#: Categories before the last link, rounds in which their groups of terms are formed.
GROUPS, ROUNDS = 3, 10
PROBABILITIES = (*(f"p_group_{i + 1}" for i in range(GROUPS)), "p_toxic")
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def terms_of(words: set[str]) -> set[str]:
    """The words and the beginnings of longer ones, marked by a star."""
    return words.union([w[:4] + "*" for w in words if len(w) > 5], [w[:5] + "*" for w in words if len(w) > 6])


def _terms(sample: DataFrame, text_col: str) -> list[str]:
    """The terms that speak most for label 1 by log-likelihood ratio: TERMS of them at most."""

    def run(batches):
        for batch in batches:
            y, w = [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = terms_of(set(words_of(text)))
                y += [label] * len(own)
                w += own
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.float64()), pa.array(w, pa.string())], names=["y", "w"])

    totals = {r["y"]: r["n"] for r in sample.groupBy(F.col("__y").alias("y")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1.0, 0), totals.get(0.0, 0)
    if not n1 or not n0:
        return []
    found = sample.select("__y", F.col(f"`{text_col}`")).mapInArrow(tidy(run), "y double, w string").groupBy("w").agg(F.sum(F.col("y")).alias("a"), F.sum(1 - F.col("y")).alias("b"))
    a, b, share = F.col("a") + 0.5, F.col("b") + 0.5, n1 / (n1 + n0)
    ratio = 2 * (a * F.log(a / ((a + b) * share)) + b * F.log(b / ((a + b) * (1 - share))))
    found = found.where((F.col("a") + F.col("b") >= MIN_DOCS) & (a * n0 > b * n1)).withColumn("s", F.round(ratio, 6))
    return [r["w"] for r in found.where(F.col("s") >= LEAST_RATIO).orderBy(F.desc("s"), "w").limit(TERMS).collect()]


def held_terms(text: str | None, terms: dict[str, int]) -> tuple[list[int], int]:
    """The terms of a text by number, and its number of words."""
    words = words_of(text)
    return sorted(terms[t] for t in terms_of(set(words)).intersection(terms)), len(words)


def matrix(rows: list[tuple[list[int], int]], terms: int) -> np.ndarray:
    """A row for each text: presence of each term, and the log of the number of words."""
    x = np.zeros((len(rows), terms + 1), np.float32)
    for i, (held, words) in enumerate(rows):
        x[i, held] = 1
        x[i, -1] = np.log1p(words) / 10
    return x


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the last one the intercept, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = ((x * (p * (1 - p)).astype(np.float32)[:, None]).T @ x).astype(np.float64) + np.diag(penalty)
        step = np.linalg.solve(hess, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def groups_of(x: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """A group for each column of x (documents x terms): spherical k-means over the columns.
    The first centre is the first column, each further one the column least like those before."""
    v = x.T.astype(np.float64)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    pick = [0]
    while len(pick) < min(groups, len(v)):
        pick.append(int((v @ v[pick].T).max(axis=1).argmin()))
    centre = v[pick]
    for _ in range(ROUNDS):
        home = (v @ centre.T).argmax(axis=1)
        centre = np.array([v[home == g].sum(axis=0) if (home == g).any() else centre[g] for g in range(len(centre))])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return (v @ centre.T).argmax(axis=1)


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> list[np.ndarray]:
    """One model for each column of labels; model k sees x and the probabilities of the k before
    it, for each row those of models that were learned without the row's fold."""
    models = []
    for k in range(labels.shape[1]):
        models.append(logistic(x, labels[:, k]))
        if k + 1 == labels.shape[1]:
            break
        out = np.full(len(x), labels[:, k].mean())
        for f in range(folds):
            own = fold == f
            if own.any() and (~own).any():
                out[own] = probability(x[own], logistic(x[~own], labels[~own, k]))
        x = np.column_stack([x, out.astype(np.float32)])
    return models


def chain(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    """The probability of each link, one after the other."""
    for w in models:
        x = np.column_stack([x, probability(x, w)])
    return x[:, -len(models) :]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """The chain of GROUPS categories and toxic, or None where the labels don't hold both 0 and
    1 or no term speaks for 1.  At most SAMPLE_ROWS labelled rows, written out once.  Folds go
    by a hash of the terms, so equal documents share one."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.table(labelled_sample(docs, labels, label_col, id_col, text_col, SAMPLE_ROWS).select("__y", F.col(f"`{text_col}`").alias("__text")), "sample")
    words = _terms(sample, "__text")
    if not words:
        return None
    terms = {w: i for i, w in enumerate(words)}

    def run(batches):
        for batch in batches:
            rows = [held_terms(t, terms) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.int64())], names=["y", "held", "n"])

    # as numbers of terms, few a row: the dense matrix is made once, on the driver
    got = sorted((tuple(r["held"]), r["n"], r["y"]) for r in sample.select("__y", "__text").mapInArrow(tidy(run), "y double, held array<int>, n long").collect())
    scratch.drop(sample)
    return learned(got, terms)


def learned(rows: list[tuple[tuple[int, ...], int, float]], terms: dict[str, int]) -> dict:
    """The model of rows (terms by number, words, label)."""
    y, x = np.array([r[2] for r in rows]), matrix([(list(r[0]), r[1]) for r in rows], len(terms))
    fold = np.array([zlib.crc32(repr(r[:2]).encode()) % FOLDS for r in rows])
    held = x[:, : len(terms)]
    group = groups_of(held[y == 1])
    categories = [y * (held[:, group == g].sum(axis=1) > 0) for g in range(GROUPS)]
    return {"terms": terms, "groups": group, "models": fit_chain(x, np.column_stack([*categories, y]), fold)}


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = (), threshold: float = 0.5) -> DataFrame:
    """id, the columns of `keep`, PROBABILITIES (0 to 1), toxic (1 if p_toxic >= threshold).

    A null text counts as an empty one.  Without a model every probability is 0.  Rows are
    independent, so repeated rows and null ids come back as they are.  Columns of `keep` that
    are named like a result are left out.
    """
    keep = kept_columns(keep, [id_col, *PROBABILITIES, "toxic"])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            p = chain(matrix([held_terms(t, model["terms"]) for t in texts], len(model["terms"])), model["models"]).astype(np.float64) if model and texts else np.zeros((len(texts), len(PROBABILITIES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(np.ascontiguousarray(c)) for c in p.T), pa.array((p[:, -1] >= threshold).astype(np.int32))], names=[id_col, *keep, *PROBABILITIES, "toxic"])

    used = docs.select(*numbered([id_col, *keep, text_col]))
    return used.mapInArrow(tidy(run), ", ".join([*fields(docs.schema, [id_col, *keep]), *(f"{p} double" for p in PROBABILITIES), "toxic int"]))
