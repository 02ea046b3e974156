"""JSON shapes of the command line and the tool server: enum names are capitalised there."""

from __future__ import annotations

import json


def memory(row: dict, vector: bool = False) -> dict:
    keys = ("id", "content", "agent_id", "session_id", "created_at", "accessed_at", "access_count", "importance", "ttl_secs")
    out = {k: row[k] for k in keys} | {"memory_type": row["memory_type"].title(), "scope": row["scope"].title(), "metadata": json.loads(row["metadata"] or "{}")}
    return out | ({"vector": list(row["vector"])} if vector else {})


def hits(found: list[dict], vector: bool = False) -> dict:
    return {"count": len(found), "hits": [{"score": h["score"], "similarity": h["similarity"], "memory": memory(h, vector)} for h in found]}


def table(rows: list[dict], columns: tuple[str, ...] = ("id", "memory_type", "agent_id", "importance", "content")) -> str:
    cell = lambda v: (s if len(s := str(v)) <= 80 else s[:79] + "…").replace("\n", " ")
    return "\n".join(["\t".join(columns), *("\t".join(cell(r[c]) for c in columns) for r in rows)])
