"""Behaviour of stores, sessions, caches and surfaces, with an explicit clock."""

import io
import json

import pytest

from memstore import cli
from memstore.errors import DimensionMismatch, Invalid, Locked, NotFound, ReadOnlyError, WrongPassphrase
from memstore.functions.scoring import Weights
from memstore.operators.recall import Request
from memstore.serve import Server
from memstore.store import Store

E1, E2, E3 = [1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0]


class Clock:
    def __init__(self):
        self.t = 1_700_000_000

    def __call__(self):
        return self.t


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def store(spark, tmp_path, clock):
    return Store.create(spark, str(tmp_path / "s"), None, 4, clock)


def again(store, **options):
    return Store.open(store.spark, store.path, clock=store.clock, **options)


def test_remember_reopen_recall(store):
    a = store.remember("the user likes tea", "semantic", E1, importance=0.9, metadata={"topic": "prefs", "n": 3})
    store.remember("a refund", "episodic", E2)
    assert len(store) == 2
    store.flush()
    other = again(store)
    hits = other.recall(Request(E1, top_k=2, track_access=False))
    assert [h["content"] for h in hits] == ["the user likes tea", "a refund"] and json.loads(hits[0]["metadata"])["n"] == 3
    assert other.get(a)["memory_type"] == "semantic" and other.verify() == 2


def test_uncommitted_vanishes_and_flush_is_idle(store):
    store.remember("x", "semantic", E1)
    assert len(again(store)) == 0
    store.flush()
    store.flush()
    assert len(store.snapshots()) == 1


def test_upsert_keeps_slot_and_statistics(store, clock):
    a = store.remember("old", "semantic", E1)
    store.remember("b", "semantic", E2)
    store.flush()
    store.recall(Request(E1, top_k=1))
    store.flush()
    clock.t += 10
    store.remember("new", "semantic", E3, id=a)
    store.flush()
    row = store.get(a)
    assert (row["content"], row["slot"], row["access_count"], row["accessed_at"]) == ("new", 0, 1, clock.t - 10)
    store.delete(a)
    store.flush()
    store.delete(a)
    with pytest.raises(NotFound):
        store.get(a)
    with pytest.raises(NotFound):
        store.delete("never")
    store.remember("back", "semantic", E1, id=a)
    assert store.get(a)["slot"] == 0


def test_ttl_type_agent_filters(store, clock):
    store.remember("gone", "semantic", E1, ttl_secs=0)
    store.remember("alice private", "semantic", E1, agent_id="alice")
    store.remember("bob private", "episodic", E1, agent_id="bob")
    store.remember("bob shared", "semantic", E1, agent_id="bob", shared=True)
    names = lambda **o: {h["content"] for h in store.recall(Request(E1, track_access=False, **o))}
    assert names() == {"alice private", "bob private", "bob shared"}
    assert names(agent_id="alice") == {"alice private", "bob shared"}
    assert names(memory_types=["episodic"]) == {"bob private"} and names(memory_types=[]) == set()
    with pytest.raises(DimensionMismatch):
        store.search([1.0])
    with pytest.raises(Invalid):
        store.remember("x", "odd", E1)


def test_tracking(store):
    store.remember("a", "semantic", E1)
    store.flush()
    store.recall(Request(E1, track_access=False))
    store.flush()
    assert len(store.snapshots()) == 1
    assert store.recall(Request(E1))[0]["access_count"] == 1 and store.recall(Request(E1))[0]["access_count"] == 2
    store.flush()
    assert again(store).memories().first()["access_count"] == 2


def test_importance_breaks_ties(store):
    store.remember("low", "semantic", E1, importance=0.0)
    store.remember("high", "semantic", E1, importance=1.0)
    assert [h["content"] for h in store.recall(Request(E1, track_access=False))] == ["high", "low"]


def test_snapshots_restore_retention(store, clock):
    for i in range(5):
        store.remember(f"m{i}", "semantic", E1)
        store.flush()
        clock.t += 100
    assert [s["memory_count"] for s in store.snapshots()] == [1, 2, 3, 4, 5]
    store.restore_to(2)
    assert len(store) == 2 and len(store.snapshots()) == 6
    store.restore_to(5)
    assert len(store) == 5
    assert store.restore_to_time(1_700_000_000 + 150) == 2 and len(again(store)) == 2
    store.set_max_snapshots(3)
    store.remember("more", "semantic", E2)
    store.flush()
    assert [s["txn_id"] for s in store.snapshots()] == [7, 8, 9]
    with pytest.raises(NotFound):
        store.restore_to(1)


def test_compact(store, clock):
    ids = [store.remember(f"m{i}", "semantic", E1, ttl_secs=5 if i == 3 else None) for i in range(6)]
    store.cache_put("n", "k", b"v")
    store.delete(ids[0])
    store.flush()
    store.build_index(partitions=2)
    clock.t += 10
    assert store.compact() == {"before": 6, "after": 4}
    assert [r["slot"] for r in store.memories().collect()] == [0, 1, 2, 3] and store.has_index()
    assert len(store.snapshots()) == 1 and store.cache_get("n", "k")["value"] == b"v"
    assert len(again(store)) == 4


def test_read_only_and_writers(store):
    store.remember("a", "semantic", E1)
    store.flush()
    ro = again(store, read_only=True)
    for f in (lambda: ro.remember("b", "semantic", E1), ro.flush, ro.compact, lambda: ro.recall(Request(E1))):
        with pytest.raises(ReadOnlyError):
            f()
    ro.close()
    other = again(store)
    other.remember("b", "semantic", E1)
    other.flush()
    store.remember("c", "semantic", E1)
    with pytest.raises(Locked):
        store.flush()
    with pytest.raises(Invalid):
        Store.create(store.spark, store.path, None, 4)


def test_sessions(store):
    with store.session("ann") as s:
        s.add_turn("user", "hello", E1)
        s.add_turn("assistant", "hi", E2)
        assert {h["content"] for h in s.recall(Request(E1, agent_id="bob"))} == {"hello", "hi"}
    assert {r["memory_type"] for r in store.memories().collect()} == {"episodic"}
    with pytest.raises(Invalid):
        s.add_turn("user", "late", E1)
    t = store.session("ann")
    t.add_turn("user", "drop me", E3)
    assert t.discard() == 1 and len(store) == 2


def test_index(spark, tmp_path, clock):
    import numpy as np

    rng = np.random.default_rng(7)
    centre = rng.normal(size=(20, 32)) * 5
    x = np.repeat(centre, 30, axis=0) + rng.uniform(-0.3, 0.3, (600, 32))
    store = Store.create(spark, str(tmp_path / "i"), None, 32, clock)
    store.remember_frame(spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(x)], "content string, vector array<float>").repartition(3))
    store.build_index(n_probe=20, n_rerank=200)
    only = Weights(1, 0, 0, 0)
    found = 0
    for q in x[::60]:
        exact = {r["content"] for r in store.search(q.tolist(), 10, "l2").collect()}
        found += len(exact & {h["content"] for h in store.recall(Request(q.tolist(), metric="l2", weights=only, track_access=False))})
    assert found >= 0.95 * 100
    # rows added after the build: found pending, found committed, beside those near the same centre
    late = {f"late{c}": (centre[c] + rng.uniform(-0.3, 0.3, 32)).tolist() for c in (2, 11, 17)}
    for name, v in late.items():
        store.remember(name, "semantic", v)
    nearest = lambda v, **how: [h["content"] for h in store.recall(Request(v, metric="l2", weights=only, top_k=31, track_access=False, **how))]
    for how in ({}, {"n_probe": 20, "n_rerank": 200}):
        for (name, v), c in zip(late.items(), (2, 11, 17), strict=True):
            got = nearest(v, **how)
            assert got[0] == name and set(got[1:]) == {f"p{i}" for i in range(30 * c, 30 * c + 30)}
        store.flush()
    assert store.index_info()["vectors"] == 603
    store.drop_index()
    assert not again(store).has_index()


def test_sealed(spark, tmp_path, clock):
    path = str(tmp_path / "e")
    s = Store.create(spark, path, "secret", 4, clock)
    s.remember("plain words here", "semantic", E1, metadata={"k": "hidden"})
    s.flush()
    raw = b"".join(p.read_bytes() for p in (tmp_path / "e").rglob("*.parquet"))
    assert b"plain words" not in raw and b"hidden" not in raw
    with pytest.raises(WrongPassphrase):
        Store.open(spark, path, "other")
    s.rekey("new")
    assert Store.open(spark, path, "new").memories().first()["content"] == "plain words here"


def test_cache(store, clock):
    model = {}  # (namespace, key) -> (value, end of life): what the cache should hold
    for n, (space, key, life) in enumerate([("sums", "x", None), ("sums", "y", 5), ("sums", "z", 50), ("pages", "x", 5), ("pages", "long" * 200, None)]):
        store.cache_put(space, key, bytes([n, 0, 255]), **({"ttl_secs": life} if life else {}))
        model[space, key] = (bytes([n, 0, 255]), clock.t + life if life else None)
    asked = hits = 0
    for wait in (0, 4, 1, 60):
        clock.t += wait
        for space, key in [*model, ("pages", "y")]:
            value, end = model.get((space, key), (None, None))
            alive = value is not None and (end is None or clock.t < end)
            found = store.cache_get(space, key)
            asked, hits = asked + 1, hits + alive
            assert (found and found["value"]) == (value if alive else None)
    assert store.cache_stats()["hit_rate"] == pytest.approx(hits / asked)
    assert store.cache_purge("sums", expired_only=True) == 2 and store.cache_stats("sums")["entries"] == 1
    store.cache_delete("pages", "long" * 200)
    assert again(store).cache_get("pages", "long" * 200) is None and again(store).cache_get("sums", "x")["value"] == bytes([0, 0, 255])
    calls = []
    f = store.cached_call("memo")(lambda x: calls.append(x) or x + 1)
    assert f(1) == f(1) == 2 and calls == [1]


def test_cache_lru(store, clock):
    store.set_flush_policy(100)
    store.set_budget("n", entries=3)
    for k in "abc":
        store.cache_put("n", k, b"v")
        clock.t += 1
    store.cache_get("n", "a")
    clock.t += 1
    store.cache_put("n", "d", b"v")
    assert store.cache_get("n", "b") is None and store.cache_get("n", "a") is not None and store.evictions == 1


def test_cache_semantic(store):
    import math

    at = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), 0.0, 0.0]
    kept = {0: b"east", 30: b"between", 90: b"north"}
    for degrees, value in kept.items():
        store.cache_put_semantic("compass", f"q{degrees}", at(degrees), value, "m1")
    store.cache_put_semantic("compass", "elsewhere", at(60), b"of another model", "m2")
    store.cache_put("compass", "exact", b"no vector")
    for degrees in range(0, 100, 10):
        nearest = min(kept, key=lambda d: abs(d - degrees))
        found = store.cache_get_semantic("compass", at(degrees), "m1", threshold=math.cos(math.radians(12)))
        if abs(nearest - degrees) > 12:
            assert found is None
        else:
            assert found["value"] == kept[nearest] and found["similarity"] == pytest.approx(math.cos(math.radians(nearest - degrees)))
    assert store.cache_get_semantic("compass", at(0), "m3") is None


def test_import_and_about(store, tmp_path):
    lines = [json.dumps({"content": f"c{i}", "vector": E1, "memory_type": "odd" if i else "procedural", "importance": 2}) for i in range(3)]
    (tmp_path / "in.jsonl").write_text("\n\n".join(lines))
    assert store.import_jsonl(str(tmp_path / "in.jsonl")) == 3
    assert [(r["slot"], r["memory_type"], r["importance"]) for r in store.memories().collect()] == [(0, "procedural", 1.0), (1, "semantic", 1.0), (2, "semantic", 1.0)]
    (tmp_path / "bad.jsonl").write_text(lines[0] + "\n{nonsense\n")
    with pytest.raises(Exception, match="bad line"):
        store.import_jsonl(str(tmp_path / "bad.jsonl"))
    assert len(again(store)) == 3
    store.insert_default_manifest()
    store.remember("guide", "semantic", E1, metadata={"area": "Onboarding"}, importance=0.1)
    assert [r["is_manifest"] for r in store.about().collect()] == [True, False]


def test_cli(spark, tmp_path, capsys):
    path = str(tmp_path / "c")

    def call(*args):
        text, code = cli.run(cli.parser().parse_args(list(args)), spark)
        return text, code

    call("init", path, "--dimensions", "4")
    (tmp_path / "x.jsonl").write_text(json.dumps({"content": "one", "vector": E1, "agent_id": "ops"}))
    assert call("import", path, str(tmp_path / "x.jsonl"))[0].startswith("1 ")
    out = json.loads(call("list", path, "--format", "json", "--agent", "ops")[0])
    assert out["total"] == 1 and out["memories"][0]["memory_type"] == "Semantic"
    assert json.loads(call("recall", path, "--query", "1 0 0 0", "--format", "json")[0])["hits"][0]["memory"]["content"] == "one"
    assert json.loads(call("get", path, out["memories"][0]["id"])[0])["access_count"] == 1
    assert call("cache", path, "get", "--ns", "n", "--key", "k") == ("miss", 1)
    call("cache", path, "put", "--ns", "n", "--key", "k", "--value", "v")
    assert call("cache", path, "get", "--ns", "n", "--key", "k") == ("v", 0)
    assert "manifest" in json.loads(call("about", path, "--format", "json")[0])
    assert call("restore", path)[1] == 2 and json.loads(call("info", path)[0])["live"] == 2
    assert call("search", path, "--query", "[1,0,0,0]", "--top-k", "1")[0].count("\n") == 1


def test_tool_server(store):
    s = Server(store)
    ask = lambda method, **p: s.answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": p}))["result"]
    assert "protocolVersion" in ask("initialize") and len(ask("tools/list")["tools"]) == 12
    tool = lambda name, **a: json.loads(ask("tools/call", name=name, arguments=a)["content"][0]["text"])
    id = tool("remember", content="x", memory_type="semantic", vector=E1)["id"]
    assert tool("recall", query=E1)["hits"][0]["memory"]["vector"] == E1 and tool("stats")["live"] == 1
    assert tool("cache_put", namespace="n", key="k", value="v")["stored"] and tool("cache_get", namespace="n", key="k")["value"] == "v"
    assert tool("forget", id=id) == {"deleted": id} and tool("list") == []
    assert ask("tools/call", name="recall", arguments={})["isError"] and ask("tools/call", name="odd")["isError"]
    assert s.answer('{"method": "notifications/initialized"}') is None and "error" in s.answer("{")
    out = io.StringIO()
    s.loop(io.StringIO('{"id": 2, "method": "ping"}\n'), out)
    assert json.loads(out.getvalue()) == {"jsonrpc": "2.0", "id": 2, "result": {}}


# -- transactions -----------------------------------------------------------------


def contents(s) -> list[str]:
    return sorted(r["content"] for r in s.memories().collect())


def test_losing_writer_harms_nothing(spark, tmp_path, monkeypatch):
    """Of two handles at one transaction the first commits; the other keeps what it has pending and can go on."""
    one = Store.create(spark, str(tmp_path / "s"), None, 4)
    two = Store.open(spark, str(tmp_path / "s"))
    one.remember("first of one", "semantic", E1)
    two.remember("first of two", "semantic", E2)
    two.remember("second of two", "semantic", E3, id="shared")
    one.remember("from one", "semantic", E3, id="shared")
    one.flush()
    with pytest.raises(Locked):
        two.flush()
    assert contents(Store.open(spark, str(tmp_path / "s"))) == ["first of one", "from one"]
    assert len(two.rows) == 2
    with pytest.raises(Locked):
        two.remember_frame(spark.createDataFrame([("x", [1.0] * 4)], "content string, vector array<double>"))
    two.refresh()
    two.flush()
    again = Store.open(spark, str(tmp_path / "s"))
    assert contents(again) == ["first of one", "first of two", "second of two"]
    assert again.relation().select("slot").distinct().count() == again.relation().count() == 3


def test_torn_manifest(spark, tmp_path, monkeypatch):
    """A manifest cut short by a crash, or changed, is passed over; the store goes on."""
    from memstore import store as module

    s = Store.create(spark, str(tmp_path / "s"), None, 4)
    for text in ("a", "b"):
        s.remember(text, "semantic", E1)
        s.flush()
    (tmp_path / "s/_manifest/000000000003.json").write_text('{"txn": 3, "records": [')
    other = Store.open(spark, str(tmp_path / "s"))
    assert contents(other) == ["a", "b"] and [x["txn_id"] for x in other.snapshots()] == [1, 2]
    other.remember("c", "semantic", E1)
    with pytest.raises(Locked):  # perhaps another writer is at it
        other.flush()
    monkeypatch.setattr(module, "TORN_SECONDS", 0)
    other.flush()
    third = Store.open(spark, str(tmp_path / "s"))
    assert contents(third) == ["a", "b", "c"] and [x["txn_id"] for x in third.snapshots()] == [1, 2, 4]
    assert third.restore_to_time(2_000_000_000) == 4
    with pytest.raises(NotFound):
        third.restore_to(3)
    path = tmp_path / "s/_manifest/000000000002.json"
    path.write_text(path.read_text().replace('"count": 2', '"count": 7'))
    (tmp_path / "s/_manifest/.000000000002.json.crc").unlink(missing_ok=True)
    assert 2 not in [x["txn_id"] for x in Store.open(spark, str(tmp_path / "s")).snapshots()]


def test_bulk_upsert(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"), "pass", 4)
    frame = lambda *rows: spark.createDataFrame([(i, c, list(map(float, v))) for i, c, v in rows], "id string, content string, vector array<double>").coalesce(1)
    assert s.remember_frame(frame(("dup", "one", E1), ("other", "two", E2))) == 2
    s.recall(Request(E1, top_k=1))
    s.flush()
    slot = s.get("dup")["slot"]
    assert s.remember_frame(frame(("dup", "three", E3), ("new", "four", E1), ("new", "five", E1))) == 2
    rows = {r["id"]: r for r in Store.open(spark, str(tmp_path / "s"), "pass").memories().collect()}
    assert {k: r["content"] for k, r in rows.items()} == {"dup": "three", "other": "two", "new": "five"}
    assert rows["dup"]["slot"] == slot and rows["dup"]["access_count"] == 1 and len({r["slot"] for r in rows.values()}) == 3


def test_export_and_import_round_trip(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"), None, 4)
    s.remember("one", "semantic", E1, importance=0.3, agent_id="ann", shared=True, metadata={"a": 1}, ttl_secs=10**10)
    s.remember("two", "episodic", E2, session_id="x")
    s.recall(Request(E1, agent_id="ann"))
    s.flush()
    rows = lambda x: sorted(tuple(r) for r in x.memories().drop("slot").select(sorted(set(x.memories().columns) - {"slot"})).collect())
    s.export_jsonl(str(tmp_path / "out"), with_vector=True)
    t = Store.create(spark, str(tmp_path / "t"), None, 4)
    assert t.import_jsonl(str(tmp_path / "out")) == 2 and rows(t) == rows(s)
    s.export_sealed(str(tmp_path / "sealed"), "word")
    assert "one" not in "".join(p.read_text() for p in (tmp_path / "sealed/lines").glob("part*"))
    u = Store.create(spark, str(tmp_path / "u"), None, 4)
    with pytest.raises(WrongPassphrase):
        u.import_sealed(str(tmp_path / "sealed"), "other")
    assert u.import_sealed(str(tmp_path / "sealed"), "word") == 2 and rows(u) == rows(s)


def test_bad_line_has_a_number(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"), None, 4)
    good = '{"content": "a", "vector": [1, 0, 0, 0]}'
    (tmp_path / "bad.jsonl").write_text("\n".join([good, "", good, '{"content": "no vector"}', good, "{"]) + "\n")
    with pytest.raises(Invalid, match="line 4"):
        s.import_jsonl(str(tmp_path / "bad.jsonl"))
    assert len(s) == 0 and not s.snapshots()


def test_pruned_snapshots_leave_no_folders(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"), None, 4)
    s.set_max_snapshots(2)
    for i in range(4):
        s.remember(str(i), "semantic", E1)
        s.flush()
    assert len(list((tmp_path / "s/catalog").glob("txn*"))) == 2 and len(list((tmp_path / "s/records").glob("txn*"))) == 4
    s.compact()
    assert len(list((tmp_path / "s/records").glob("txn*"))) == 1 and contents(Store.open(spark, str(tmp_path / "s"))) == ["0", "1", "2", "3"]


def test_indexed_recall_prunes_the_scan(spark, tmp_path):
    """The candidates' slots reach the scan of the records as a filter."""
    s = Store.create(spark, str(tmp_path / "s"), None, 4)
    s.remember_frame(spark.range(200).selectExpr("concat('t', id) AS content", "array(double(id % 7), double(id % 5), 1D, double(id)) AS vector"))
    s.build_index()
    plan = s.relation([3, 5])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("In(slot, [3,5])") >= 2
    whole = [h["content"] for h in s.recall(Request([3.0, 3.0, 1.0, 3.0], top_k=3, track_access=False, n_probe=99, n_rerank=200))]
    s.drop_index()
    assert whole == [h["content"] for h in s.recall(Request([3.0, 3.0, 1.0, 3.0], top_k=3, track_access=False))]


def test_purge_is_a_transaction(store):
    for i in range(4):
        store.cache_put("a" if i % 2 else "b", str(i), b"x")
    assert store.cache_purge("a") == 2 and store.cache_purge("a") == 0
    other = Store.open(store.spark, store.path, "pass") if store.key is not None else Store.open(store.spark, store.path)
    assert other.cache_stats()["entries"] == 2
