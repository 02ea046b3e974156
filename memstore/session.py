"""Conversations: turns are working memories that a close consolidates or a discard deletes."""

from __future__ import annotations

from memstore import schema as M
from memstore.errors import Invalid, NotFound
from memstore.operators.recall import Request


class Session:
    def __init__(self, store, agent_id: str, session_id: str):
        self.store, self.agent_id, self.session_id, self.turns, self.open = store, agent_id, session_id, [], True

    def _live(self) -> None:
        if not self.open:
            raise Invalid("this session is closed")

    def add_turn(self, role: str, content: str, vector, **options) -> str:
        self._live()
        meta = {"role": M.role(role)} | (options.pop("metadata", None) or {})
        self.turns.append(self.store.remember(content, "working", vector, agent_id=self.agent_id, session_id=self.session_id, metadata=meta, **options))
        return self.turns[-1]

    def recall(self, request: Request) -> list[dict]:
        """Recall with this session's agent, whatever the request says."""
        from dataclasses import replace

        self._live()
        return self.store.recall(replace(request, agent_id=self.agent_id))

    def close(self) -> int:
        """Turns that are still working memory become episodic; their number."""
        import json

        self._live()
        n = 0
        for id in self.turns:
            try:
                r = self.store.get(id)
            except NotFound:
                continue
            if r["memory_type"] == "working":
                self.store.remember(r["content"], "episodic", r["vector"], importance=r["importance"], agent_id=r["agent_id"], session_id=r["session_id"], ttl_secs=r["ttl_secs"], shared=r["scope"] == "shared", metadata=json.loads(r["metadata"] or "{}"), id=id, created_at=r["created_at"])
                n += 1
        self.store.flush()
        self.open = False
        return n

    def discard(self) -> int:
        self._live()
        for id in self.turns:
            self.store.delete(id)
        self.store.flush()
        self.open = False
        return len(self.turns)

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        if self.open:
            self.close()
