"""Tool server: JSON-RPC 2.0, one message a line."""

from __future__ import annotations

import json
from typing import IO

from memstore import render
from memstore.errors import MemoryStoreError
from memstore.operators.recall import Request
from memstore.schema import memory_type

PROTOCOL = "2024-11-05"
_S, _N, _A, _B, _O = {"type": "string"}, {"type": "number"}, {"type": "array"}, {"type": "boolean"}, {"type": "object"}

#: name: (required arguments, optional ones)
TOOLS = {
    "about": ({}, {}),
    "remember": ({"content": _S, "memory_type": _S, "vector": _A}, {"importance": _N, "agent_id": _S, "session_id": _S, "ttl_secs": _N, "shared": _B, "metadata": _O, "id": _S}),
    "recall": ({"query": _A}, {"top_k": _N, "types": _A, "agent": _S, "metric": _S}),
    "forget": ({"id": _S}, {}),
    "list": ({}, {"include_vectors": _B}),
    "snapshot_list": ({}, {}),
    "stats": ({}, {}),
    "cache_put": ({"namespace": _S, "key": _S, "value": _S}, {"content_type": _S, "ttl_secs": _N}),
    "cache_get": ({"namespace": _S, "key": _S}, {}),
    "cache_stats": ({}, {"namespace": _S}),
    "cache_put_semantic": ({"namespace": _S, "key": _S, "vector": _A, "value": _S, "model": _S}, {"content_type": _S, "ttl_secs": _N}),
    "cache_get_semantic": ({"namespace": _S, "query": _A, "model": _S}, {"threshold": _N}),
}


class Server:
    def __init__(self, store):
        self.store = store

    def loop(self, source: IO[str], sink: IO[str]) -> None:
        for line in source:
            if line.strip() and (answer := self.answer(line)) is not None:
                sink.write(json.dumps(answer) + "\n")
                sink.flush()

    def answer(self, line: str) -> dict | None:
        """The response to a message; None for a notification."""
        try:
            m = json.loads(line)
        except ValueError:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if "id" not in m:
            return None
        try:
            return {"jsonrpc": "2.0", "id": m["id"], "result": self.result(m.get("method"), m.get("params") or {})}
        except LookupError as e:
            return {"jsonrpc": "2.0", "id": m["id"], "error": {"code": -32601, "message": str(e)}}

    def result(self, method: str, params: dict) -> dict:
        if method == "initialize":
            return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "memstore", "version": "1"}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": n.replace("_", " "), "inputSchema": {"type": "object", "properties": need | rest, "required": list(need)}} for n, (need, rest) in TOOLS.items()]}
        if method != "tools/call":
            raise LookupError(f"unknown method: {method}")
        name, args = params.get("name"), params.get("arguments") or {}
        try:
            if name not in TOOLS:
                raise MemoryStoreError(f"unknown tool: {name}")
            if missing := [k for k in TOOLS[name][0] if k not in args]:
                raise MemoryStoreError(f"missing argument: {', '.join(missing)}")
            out, bad = getattr(self, name)(**args), False
        except (MemoryStoreError, TypeError) as e:
            out, bad = str(e), True
        return {"content": [{"type": "text", "text": out if isinstance(out, str) else json.dumps(out)}], "isError": bad}

    def about(self) -> list:
        return [render.memory(r.asDict(True)) for r in self.store.about().collect()]

    def remember(self, content, memory_type, vector, **options) -> dict:
        id = self.store.remember(content, memory_type, vector, **options)
        self.store.flush()
        return {"id": id}

    def recall(self, query, top_k=10, types=None, agent=None, metric="cosine") -> dict:
        kinds = None if types is None else [memory_type(t) for t in types]
        return render.hits(self.store.recall(Request(query, int(top_k), kinds, agent, metric, track_access=False)), vector=True)

    def forget(self, id) -> dict:
        self.store.delete(id)
        self.store.flush()
        return {"deleted": id}

    def list(self, include_vectors=False) -> list:
        return [render.memory(r.asDict(True), include_vectors) for r in self.store.memories().collect()]

    def snapshot_list(self) -> list:
        return self.store.snapshots()

    def stats(self) -> dict:
        return self.store.stats()

    def cache_put(self, namespace, key, value, content_type=None, ttl_secs=None) -> dict:
        self.store.cache_put(namespace, key, value.encode(), content_type, ttl_secs)
        self.store.flush()
        return {"stored": True}

    def _got(self, hit: dict | None) -> dict:
        return {"hit": False} if hit is None else {"hit": True, "value": hit["value"].decode("utf-8", "replace"), "content_type": hit["content_type"]} | ({"similarity": hit["similarity"]} if "similarity" in hit else {})

    def cache_get(self, namespace, key) -> dict:
        return self._got(self.store.cache_get(namespace, key))

    def cache_stats(self, namespace=None) -> dict:
        return self.store.cache_stats(namespace)

    def cache_put_semantic(self, namespace, key, vector, value, model, content_type=None, ttl_secs=None) -> dict:
        self.store.cache_put_semantic(namespace, key, vector, value.encode(), model, content_type=content_type, ttl_secs=ttl_secs)
        self.store.flush()
        return {"stored": True}

    def cache_get_semantic(self, namespace, query, model, threshold=0.97) -> dict:
        return self._got(self.store.cache_get_semantic(namespace, query, model, threshold))
