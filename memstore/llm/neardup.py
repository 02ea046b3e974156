"""Embedding near-duplicates (operator 1).

Method: spherical k-means gives every vector a home cell; blocks of a cell are compared by
matrix products.  To lose no link, a vector also visits each foreign cell in which a partner
could have its home: with angle t of the threshold, home centre a and foreign centre b, no
vector within t of x lies nearer to b than to a unless x.(a-b) <= sin(t) |a-b|, and none lies
in b's cell unless x is within t of that cell's radius.  Each vector counts its links in its
home cell, where all its partners are at home or visiting.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memstore.llm.common import KEY, Scratch, components, forest, keyed, tidy

THRESHOLD = 0.93
#: Least rows of one side of a tile, and rows that are multiplied at a time.
BLOCK = 1024
#: Least tiles' sides that all vectors make (so that few vectors still fill a cluster), and
#: most bytes of vectors on one side of a tile.
SIDES, SIDE_BYTES = 4096, 8_000_000
#: Bound of the sample that the centres are fitted on, its rows for each centre of the largest
#: number that the vectors could fill, least vectors for each centre, numbers of centres to
#: choose from, rows of the sample that tell their visits, comparisons that cost as much as
#: sending a vector once.  The sample's vectors take SAMPLE_BYTES at most.
SAMPLE_BYTES = 64_000_000
SAMPLE_ROWS, SAMPLE_PER_CELL, ROWS_PER_CELL, CELLS, VISITORS, SENDING = 65_536, 64, 64, (4, 16, 64, 256, 1024), 2048, 256
ITERATIONS = 12


def block_rows(n: int, dim: int) -> int:
    """Rows of one side of a tile, for n vectors: a vector is sent once for each tile of its
    cell, so sides grow with n as far as a task's memory allows."""
    return max(BLOCK, min(n // SIDES, SIDE_BYTES // (8 * max(dim, 1))))


def sample_rows(n: int, dim: int) -> int:
    """Rows of the sample: SAMPLE_PER_CELL for each centre that n vectors could fill, within both bounds."""
    most = max([k for k in CELLS if k * ROWS_PER_CELL <= n] or CELLS[:1])
    return max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(dim, 1)), max(SAMPLE_ROWS // 4, most * SAMPLE_PER_CELL)))


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The centre of greatest cosine for each row, a bounded matrix at a time."""
    return np.concatenate([(x[i : i + 8 * BLOCK] @ centre.T).argmax(axis=1) for i in range(0, len(x), 8 * BLOCK)])


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """k unit centres of the unit rows of x."""
    rng = np.random.default_rng(seed)
    centre = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(ITERATIONS):
        home = nearest(x, centre)
        total = np.zeros_like(centre)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1)
        empty = norm < 1e-9
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centre = total / np.linalg.norm(total, axis=1)[:, None]
    return centre


def reach(s: np.ndarray, home: np.ndarray, apart: np.ndarray, slack: float) -> np.ndarray:
    """Which cells may hold partners' homes, the own one included; s: cosines with the centres."""
    return s[np.arange(len(s)), home][:, None] - s <= slack * apart[home]


def choose_centres(x: np.ndarray, n: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres and their distances: of the numbers in CELLS the one of least cost for n rows, by
    the visits that rows of the sample would make.  More cells mean fewer comparisons only
    where the vectors keep to their cells."""
    best = None
    for k in CELLS:
        k = min(k, len(x))
        if best is not None and k * ROWS_PER_CELL > n:
            break
        centre = spherical_kmeans(x, k)
        apart = np.stack([np.linalg.norm(centre - c, axis=1) for c in centre])
        s = x[:VISITORS] @ centre.T
        visits = reach(s, s.argmax(axis=1), apart, slack).sum(axis=1).mean()
        cost = visits * (n / k + SENDING)
        if best is None or cost < best[0]:
            best = (cost, centre, apart)
    return best[1], best[2]


def parts(rows: np.ndarray) -> list[np.ndarray]:
    """Some row numbers, BLOCK at a time."""
    return [rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)]


def tile_links(x: np.ndarray, name: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray | None, both: bool, threshold: float, step: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each row: the rows a compared with the rows b (None: a with itself),
    `step` rows of either at a time.  A link counts as the partner's copies, for b's rows only
    if `both`; root is the least name that a row's links in this tile lead to."""
    links, u, v = np.zeros(len(x), np.int64), [], []
    for i in range(0, len(a), step):
        for j in range(i if b is None else 0, len(a if b is None else b), step):
            p, q = a[i : i + step], (a if b is None else b)[j : j + step]
            near = x[p] @ x[q].T >= threshold
            own = b is None and i == j
            if own:
                near[np.arange(len(p)), np.arange(len(p))] = False
            links[p] += near @ copies[q]
            if both if b is not None else not own:
                links[q] += near.T @ copies[p]
            r, c = np.nonzero(near)
            if len(r):
                node, low = forest(name[p][r], name[q][c])
                u.append(node)
                v.append(low)
    root = name.copy()
    if u:
        nodes, low = forest(np.concatenate(u), np.concatenate(v))
        at = np.minimum(np.searchsorted(nodes, name), len(nodes) - 1)
        root = np.where(nodes[at] == name, low[at], name)
    return links, root


def unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1)[:, None]


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int | None = None
) -> DataFrame:
    """id, n_links, component_id, kept; one row for each input row.

    Links: cosine >= threshold in double precision, same length, labels equal and not null.
    A vector that is null, empty, zero or has a null or non-finite component, and one
    without a label, has no link and is its own component.  Equal vectors of a label are
    one during the comparison and count as many.  Repeated and null ids: each row is a
    vector of its own; component_id is then the least id in the component.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neardup")
    v = keyed(vectors, id_col, [vector_col, label_col], scratch)
    own = F.col(vector_col)
    norm = F.aggregate(own, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    good = own.isNotNull() & F.col(label_col).isNotNull() & F.forall(own, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))) & (norm > 0) & (norm < float("inf"))
    v = v.select(KEY, F.col(id_col).alias("__id"), F.col(label_col).alias("__g"), F.when(F.coalesce(good, F.lit(False)), own.cast("array<double>")).alias("__v"))
    v = v.withColumn("__h1", F.xxhash64("__v")).withColumn("__h2", F.xxhash64(F.col("__v"), F.lit(7)))
    use = v.where("__v is not null")
    reps = use.groupBy("__g", "__h1", "__h2").agg(F.min(F.struct(KEY, "__v")).alias("r"), F.count("*").alias("__n"))
    reps = scratch.table(reps.select("__g", "__h1", "__h2", F.col(f"r.{KEY}").alias("__rep"), F.col("r.__v").alias("__v"), "__n", F.size("r.__v").alias("__d")), "reps")
    n, dim = reps.count(), reps.groupBy("__d").count().orderBy(F.desc("count"), "__d").limit(1).collect()
    rep_of = use.join(reps.select("__g", "__h1", "__h2", "__rep", "__n"), ["__g", "__h1", "__h2"]).select(KEY, "__rep", "__n")
    if not n:
        return v.select(F.col("__id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"), F.lit(True).alias("kept"))

    # home cells
    dim = dim[0]["__d"]
    sample = reps.where(F.col("__d") == dim).orderBy(F.xxhash64("__rep"), "__rep").limit(sample_rows(n, dim)).select("__v").toPandas()
    block = block or block_rows(n, dim)
    angle = math.acos(threshold)
    slack = math.sin(min(angle, math.pi / 2)) + 1e-9
    centre, apart = choose_centres(unit(sample["__v"]), n, slack)
    k = len(centre)

    def at_home(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            home, near = np.zeros(len(pdf), np.int32), np.ones(len(pdf))
            fit = np.flatnonzero((pdf["__d"] == dim).to_numpy())
            for part in parts(fit):
                s = unit(pdf["__v"].iloc[part]) @ centre.T
                home[part], near[part] = s.argmax(axis=1), s.max(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(near)], names=[*batch.schema.names, "__home", "__near"])

    rows = reps.select("__rep", "__g", "__d", "__n", "__v")
    homes = scratch.table(rows.mapInArrow(tidy(at_home), "__rep long, __g {}, __d int, __n long, __v array<double>, __home int, __near double".format(reps.schema["__g"].dataType.simpleString())), "homes")
    radius = np.zeros(k)
    for r in homes.where(F.col("__d") == dim).groupBy("__home").agg(F.min("__near").alias("m")).collect():  # k rows at most
        radius[r["__home"]] = math.acos(max(-1.0, min(1.0, r["m"])))
    within = np.cos(np.minimum(radius + angle + 1e-9, math.pi))

    def visits(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            cells = [[h] for h in pdf["__home"]]
            fit = np.flatnonzero((pdf["__d"] == dim).to_numpy())
            for part in parts(fit):
                s = unit(pdf["__v"].iloc[part]) @ centre.T
                h = pdf["__home"].to_numpy()[part]
                go = reach(s, h, apart, slack) & (s >= within[None])
                go[np.arange(len(part)), h] = False
                for i, row in zip(part, go, strict=True):
                    cells[i] += np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "__cells"])

    spread = homes.select("__rep", "__g", "__d", "__n", "__v", "__home").mapInArrow(tidy(visits), "__rep long, __g {}, __d int, __n long, __v array<double>, __home int, __cells array<int>".format(reps.schema["__g"].dataType.simpleString()))
    spread = scratch.table(spread.select("*", F.explode("__cells").alias("__cell")).drop("__cells").withColumn("__guest", F.col("__cell") != F.col("__home")), "visits")
    cell = ["__g", "__d", "__cell"]
    sizes = spread.groupBy(*cell).agg(F.ceil(F.count_if(~F.col("__guest")) / block).cast("int").alias("__nh"), F.ceil(F.count_if(F.col("__guest")) / block).cast("int").alias("__nv")).where("__nh > 0")
    spread = spread.join(sizes, cell)
    mine = F.pmod(F.xxhash64("__rep"), F.when(F.col("__guest"), F.col("__nv")).otherwise(F.col("__nh"))).cast("int")
    spread = spread.withColumn("__b", mine)
    # tiles (i, j): blocks i <= j at home, or home block i and guest block -1-j
    at_home_tiles = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("__nh") - 1), lambda o: F.struct(F.least(o, F.col("__b")).alias("i"), F.greatest(o, F.col("__b")).alias("j"))),
        F.when(F.col("__nv") > 0, F.transform(F.sequence(F.lit(0), F.col("__nv") - 1), lambda o: F.struct(F.col("__b").alias("i"), (-1 - o).alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>")),
    )
    guest_tiles = F.transform(F.sequence(F.lit(0), F.col("__nh") - 1), lambda o: F.struct(o.alias("i"), (-1 - F.col("__b")).alias("j")))
    tiles = spread.withColumn("__t", F.explode(F.when(F.col("__guest"), guest_tiles).otherwise(at_home_tiles))).select(*cell, F.col("__t.i").alias("__i"), F.col("__t.j").alias("__j"), "__rep", "__n", "__v", "__b", "__guest")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["__i"].iloc[0], pdf["__j"].iloc[0]
        x, name, copies = unit(pdf["__v"]), pdf["__rep"].to_numpy(), pdf["__n"].to_numpy()
        left = (~pdf["__guest"] & (pdf["__b"] == i)).to_numpy()
        links, root = tile_links(x, name, copies, np.flatnonzero(left), None if i == j else np.flatnonzero(~left), j > i, threshold)
        some = (links > 0) | (root != name)
        return pd.DataFrame({"rep": name[some], "links": links[some], "root": root[some]})

    found = scratch.table(tiles.groupBy(*cell, "__i", "__j").applyInPandas(compare, "rep long, links long, root long"), "links")
    joined = components(found.where("rep <> root"), scratch, "rep", "root")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    out = rep_of.join(links, rep_of["__rep"] == links["rep"], "left").join(joined, rep_of["__rep"] == joined["node"], "left")
    out = out.select(KEY, (F.coalesce("links", F.lit(0)) + F.col("__n") - 1).alias("n_links"), F.coalesce("component", "__rep").alias("__c"))
    out = scratch.only(out, "result")
    out = v.select(KEY, "__id").join(out, KEY, "left").withColumn("__c", F.coalesce("__c", KEY))
    least = out.groupBy("__c").agg(F.min("__id").alias("component_id"))
    out = out.join(least, "__c")
    return out.select(F.col("__id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col(KEY) == F.col("__c")).alias("kept"))
