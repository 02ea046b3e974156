"""Command line: python -m memstore.cli COMMAND STORE [options].  The passphrase is in MEMSTORE_PASSPHRASE."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from memstore import render
from memstore.errors import MemoryStoreError
from memstore.operators.recall import Request
from memstore.schema import memory_type
from memstore.sources.jsonl import parse_vector
from memstore.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="memstore", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, **options):
        c = sub.add_parser(name)
        c.add_argument("store")
        for k, v in options.items():
            v = dict(v)
            positional = v.pop("positional", False)
            c.add_argument(k if positional else "--" + k.replace("_", "-"), **v)
        return c

    flag, text, num, name = {"action": "store_true"}, {"default": None}, {"type": int, "default": None}, {"positional": True}
    form = {"choices": ("table", "json", "jsonl"), "default": "table"}
    query = {"query": text, "query_file": text}
    add("init", dimensions={"type": int, "default": 768}, no_manifest=flag)
    for c in ("info", "compact", "verify", "snapshots"):
        add(c)
    add("rekey", new_passphrase={"required": True})
    add("import", file=name)
    add("export", folder=name, vector=flag)
    add("index", drop=flag, partitions=num, subspaces=num, n_probe={"type": int, "default": 8}, n_rerank={"type": int, "default": 64})
    add("search", **query, top_k={"type": int, "default": 5}, format=form)
    add("about", format=form, manifest_only=flag)
    add("get", id=name, vector=flag)
    add("list", format=form, type={"action": "append", "default": None}, agent=text, limit=num, offset={"type": int, "default": 0}, sort={"choices": ("created", "importance", "id"), "default": "created"}, vector=flag)
    add("recall", **query, top_k={"type": int, "default": 10}, format=form, type={"action": "append", "default": None}, agent=text, metric={"default": "cosine"}, n_probe=num, n_rerank=num, no_track=flag)
    add("restore", to_txn=num, to_time=num)
    add("serve", mcp={"action": "store_true", "required": True})
    add("demo")
    c = add("cache", action={"positional": True, "choices": ("get", "put", "delete", "stats", "purge")}, ns=text, key=text, value=text, value_file=text, content_type=text, ttl=num, expired=flag)
    del c
    return p


def query_of(args) -> list[float]:
    if args.query_file:
        with sys.stdin if args.query_file == "-" else open(args.query_file, encoding="utf-8") as f:
            return parse_vector(f.read())
    return parse_vector(args.query or "")


def show(out: dict | list, rows: list[dict] | None, form: str, vector: bool = False) -> str:
    if form == "json" or rows is None:
        return json.dumps(out, indent=2)
    return "\n".join(json.dumps(render.memory(r, vector)) for r in rows) if form == "jsonl" else render.table(rows)


def run(args, spark: SparkSession) -> tuple[str, int]:
    """What the command prints, and its exit code."""
    secret = os.environ.get("MEMSTORE_PASSPHRASE")
    if args.command == "init":
        s = Store.create(spark, args.store, secret, args.dimensions)
        if not args.no_manifest:
            s.insert_default_manifest(os.path.basename(args.store))
        s.flush()
        return f"created {args.store} ({args.dimensions} dimensions)", 0
    if args.command == "demo":
        s = Store.create(spark, args.store, secret, 4)
        for i, (t, kind) in enumerate([("likes tea", "semantic"), ("asked for a refund", "episodic"), ("restart steps", "procedural")]):
            s.remember(t, kind, [float(i == j) for j in range(4)])
        s.flush()
        return show(render.hits(s.recall(Request([1.0, 0.0, 0.0, 0.0], top_k=2))), None, "json"), 0
    reads = ("info", "verify", "snapshots", "search", "about", "get", "list", "export")
    s = Store.open(spark, args.store, secret, read_only=args.command in reads or args.command == "recall" and args.no_track)
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    match args.command:
        case "info":
            return json.dumps(s.stats() | {"cache": s.cache_stats(), "index": s.index_info()}, indent=2), 0
        case "compact":
            return json.dumps(s.compact()), 0
        case "verify":
            return f"{s.verify()} memories verified", 0
        case "snapshots":
            return "\n".join(json.dumps(x) for x in s.snapshots()), 0
        case "rekey":
            s.rekey(args.new_passphrase)
            return "rekeyed", 0
        case "import":
            return f"{s.import_jsonl(args.file)} memories imported", 0
        case "export":
            s.export_jsonl(args.folder, args.vector)
            return f"exported to {args.folder}", 0
        case "index":
            s.drop_index() if args.drop else s.build_index(args.partitions, args.subspaces, args.n_probe, args.n_rerank)
            return json.dumps(s.index_info()), 0
        case "search":
            found = rows(s.search(query_of(args), args.top_k))
            return show({"count": len(found), "hits": [{"similarity": h["similarity"], "memory": render.memory(h)} for h in found]}, found, args.format), 0
        case "about":
            found = rows(s.about(args.manifest_only))
            out = {"path": args.store, "stats": s.stats(), "manifest": [render.memory(r) for r in found if r["is_manifest"]], "onboarding": [render.memory(r) for r in found if not r["is_manifest"]]}
            return show(out, found, args.format), 0
        case "get":
            return json.dumps(render.memory(s.get(args.id), args.vector), indent=2), 0
        case "list":
            kinds = None if args.type is None else [memory_type(t) for t in args.type]
            total = s.listing(types=kinds, agent=args.agent).count()
            found = rows(s.listing(sort=args.sort, types=kinds, agent=args.agent, offset=args.offset, limit=args.limit))
            return show({"total": total, "count": len(found), "memories": [render.memory(r, args.vector) for r in found]}, found, args.format, args.vector), 0
        case "recall":
            kinds = None if args.type is None else [memory_type(t) for t in args.type]
            found = s.recall(Request(query_of(args), args.top_k, kinds, args.agent, args.metric, n_probe=args.n_probe, n_rerank=args.n_rerank, track_access=not args.no_track))
            s.close()
            return show(render.hits(found), found, args.format), 0
        case "restore":
            if (args.to_txn is None) == (args.to_time is None):
                return "give one of --to-txn and --to-time", 2
            s.restore_to(args.to_txn) if args.to_txn is not None else s.restore_to_time(args.to_time)
            return f"restored as transaction {s.manifest['txn']}", 0
        case "serve":
            from memstore.serve import Server

            Server(s).loop(sys.stdin, sys.stdout)
            return "", 0
        case "cache":
            return _cache(s, args)
    raise AssertionError(args.command)


def _cache(s: Store, args) -> tuple[str, int]:
    if args.action == "get":
        hit = s.cache_get(args.ns, args.key)
        s.flush()
        return (hit["value"].decode("utf-8", "replace"), 0) if hit else ("miss", 1)
    if args.action == "put":
        value = open(args.value_file, "rb").read() if args.value_file else (args.value or "").encode()
        s.cache_put(args.ns, args.key, value, args.content_type, args.ttl)
        s.flush()
        return "stored", 0
    if args.action == "delete":
        s.cache_delete(args.ns, args.key)
        s.flush()
        return "deleted", 0
    if args.action == "stats":
        return json.dumps(s.cache_stats(args.ns)), 0
    return f"{s.cache_purge(args.ns, args.expired)} entries purged", 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("memstore").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        text, code = run(args, spark)
    except MemoryStoreError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(text, end="\n" if text else "")
    return code


if __name__ == "__main__":
    sys.exit(main())
