"""Every query against its DuckDB text at the smallest scale, and properties of single functions."""

import math
import os

import duckdb
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from memstore.operators import ann, cache, recall
from memstore.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are missing")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, (float, np.floating)) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = lambda found: sorted(repr(tuple(plain(x) for x in r)) for r in found)
    assert rows(got.select(*names).collect()) == rows(want.fetchall())


def test_without_oracle(spark):
    assert QUERIES["ann_recall_at_10"](spark, DATA).first()[0] >= 0.9
    assert all(r["same"] and r["bound"] for r in QUERIES["aead_roundtrip"](spark, DATA).collect())
    assert QUERIES["index_info"](spark, DATA).first()["subspaces"] == 8


def test_recall_batch_in_blocks(spark, monkeypatch):
    """More queries than a block holds: the same rows as in one block, and a row of each query."""
    found = lambda: sorted(tuple(r) for r in QUERIES["recall_batch_all"](spark, DATA).collect())
    whole = found()
    monkeypatch.setattr(recall, "MAX_QUERIES", 7)
    monkeypatch.setattr(recall, "CELLS", 100)
    assert found() == whole and {r[0] for r in whole} == set(range(0, 500, 20))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), max_size=12), st.integers(0, 6), st.integers(0, 20))
def test_lru_equals_a_loop(spark, puts, entries, size):
    rows = [(i, "n", at, n) for i, (at, n) in enumerate(puts)]
    got = {r["pos"] for r in cache.within_budget(spark.createDataFrame(rows, "pos long, namespace string, accessed_at long, size_bytes long"), entries, size).collect()}
    left = list(rows)
    while left and (len(left) > entries or sum(r[3] for r in left) > size):
        left.remove(min(left, key=lambda r: (r[2], r[0])))
    assert got == {r[0] for r in left}


def test_probe_prunes_partitions(spark, tmp_path):
    mem = spark.createDataFrame([(i, [float(i % 4), float(i)], False) for i in range(40)], "slot long, vector array<float>, deleted boolean")
    index = ann.train(mem, partitions=4, subspaces=2)
    ann.write_postings(ann.encode(mem, index), str(tmp_path / "p"))
    postings = spark.read.schema("slot long, code binary, part int").parquet(str(tmp_path / "p"))
    parts = ann.probe(index, [0.0, 0.0], 2)
    assert len(parts) == 2 and "PartitionFilters: [part" in postings.where(postings["part"].isin(parts))._jdf.queryExecution().toString().replace("isnotnull(part), ", "")
    assert ann.partition_count(600) == 25 and ann.subspace_count(7) == 1


def test_streaming(spark, tmp_path):
    from memstore.streaming import access_log

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"slot":1,"at":10}\n{"slot":1,"at":20}\n{"slot":2,"at":5}\n')
    q = access_log.folded(access_log.read_log(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("folded").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("folded").collect()} == {(1, 20, 2), (2, 5, 1)}
