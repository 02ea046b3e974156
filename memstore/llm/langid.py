"""Language identification (operator 6).

Method: rank-order profiles (Cavnar and Trenkle, 1994).  A language's profile is the ranking
of its most frequent letter n-grams, n = 1 to 3, over all learning documents.  A document is
given the language whose profile has the least out-of-place distance from the document's own
ranking.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memstore.llm.common import fields, kept_columns, numbered, tidy

#: Ranks that a profile and a document keep.
TOP = 400
#: Letter codes: 0 a word edge, 1-26 a-z, then other letters by a rule of their code point.
CODES = 64
UNKNOWN = "und"
#: Languages whose counts a task holds before it passes them on.
HELD = 32


@functools.lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """The code of each code point's lower case; 0 for what isn't a letter."""
    code = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            code[cp] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 * (CODES - 27) // 2**32
    return code


def grams(text: str) -> np.ndarray | None:
    """Codes of the text's 1- to 3-grams, word edges counting as a letter at either end; None without letters."""
    codes = letter_codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int32)
    if not codes.any():
        return None
    edge = codes == 0
    codes = np.concatenate([[0], codes[~(edge & np.append(True, edge[:-1]))], [0]]).astype(np.int32)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    inner = b > 0
    bi = codes[:-1] * CODES + codes[1:]
    bi = bi[(codes[:-1] > 0) | (codes[1:] > 0)]
    tri = (a[inner] * CODES + b[inner]) * CODES + c[inner]
    return np.concatenate([codes[codes > 0], bi + CODES, tri + CODES + CODES**2])


SPACE = CODES + CODES**2 + CODES**3


def ranking(text: str) -> np.ndarray | None:
    """The document's most frequent n-grams, most frequent first, equal counts by code."""
    found = grams(text)
    if found is None:
        return None
    found.sort()
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    count = np.diff(np.append(first, len(found)))
    key = (-count.astype(np.int64) << 20) | found[first]
    if len(key) > TOP:
        key = np.partition(key, TOP - 1)[:TOP]
    key.sort()
    return key & 0xFFFFF


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, list[int]]:
    """Profiles from all rows with a language: TOP n-gram codes of each, most frequent first.

    Tasks count n-grams by language; sums and the ranking are made by Spark.  Only the
    profiles, TOP codes for each language, reach the driver.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}

        def flush():
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "gram": at, "n": n[at]})
            sums.clear()

        for batch in batches:
            for lang, text in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                found = grams(text)
                if found is not None:
                    if lang not in sums:
                        if len(sums) >= HELD:
                            yield from flush()
                        sums[lang] = np.zeros(SPACE, np.int64)
                    own = sums[lang]
                    if len(found) < SPACE // 8:
                        np.add.at(own, found, 1)
                    else:
                        own += np.bincount(found, minlength=SPACE)
        yield from flush()

    lang, text = F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    rows = docs.where(lang.isNotNull() & text.isNotNull()).select(lang.cast("string").alias("lang"), text.alias("text"))
    total = rows.mapInPandas(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = total.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= TOP)
    out: dict[str, list[int]] = {}
    for r in ranked.orderBy("lang", "r").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def predict(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """id, the columns of `keep`, lang_pred, score (1 - distance / greatest distance).

    A null text or one without letters gets `und` and 0, as does every text if no language
    was learned.  Equal distances: the first language by name.  Rows are independent, so
    repeated rows and null ids come back as they are.  Columns of `keep` that are named like
    a result are left out.
    """
    keep = kept_columns(keep, [id_col, "lang_pred", "score"])
    langs = sorted(profiles)
    ranks = np.full((len(langs), SPACE), TOP, np.int16)
    for i, lang in enumerate(langs):
        ranks[i, profiles[lang]] = np.arange(len(profiles[lang]))

    def judge(text) -> tuple[str, float]:
        own = ranking(text) if text and langs else None
        if own is None:
            return UNKNOWN, 0.0
        known = ranks[:, own].astype(np.int32)
        out = np.where(known < TOP, np.abs(known - np.arange(len(own))), TOP).sum(axis=1)
        best = int(out.argmin())
        return langs[best], float(1 - out[best] / (TOP * len(own)))

    def run(batches):
        for batch in batches:
            got = [judge(t) for t in batch.column(1).to_pylist()]
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *rest, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[id_col, *keep, "lang_pred", "score"]
            )

    used = docs.select(*numbered([id_col, text_col, *keep]))
    return used.mapInArrow(tidy(run), ", ".join([*fields(docs.schema, [id_col, *keep]), "lang_pred string", "score double"]))
