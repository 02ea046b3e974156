"""Packing token streams into sequences (operator 3).

Method: order-preserving dynamic programming.  The documents of a partition form one token
stream in their order.  A sequence is a window of the stream; windows may end at document
ends (free), at sentence ends (SENTENCE_COST) or anywhere else (TRUNCATION_COST), and a
window pays its padding.  The least total cost up to each cut is found with a monotone
queue: with g(i) = cost(i) + position(i), the best start of a window that ends at p is the
front of a queue of increasing g whose positions lie within one window of p.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from memstore.llm.bpe import tokenizer
from memstore.llm.common import numbered, slices, tidy

WINDOW = 2048
#: Closes every document.
END_ID = 1
#: Costs of a cut, in padded tokens.
SENTENCE_COST, TRUNCATION_COST = 1, 8
#: Tokens that may wait for their cuts; beyond, the best cuts so far hold.
HORIZON = 1 << 24
#: Least tokens that gather before it is asked which cuts are settled.  That they are doesn't depend on when it is asked.
GATHER = 1 << 21
#: Bytes of text that are encoded at a time.
SLICE = 8_000_000

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Cuts:
    """The dynamic program over a growing stream: cuts of least cost up to each place.

    What follows the last cut is shorter than a window and is left to the caller.  A
    truncated cut is tried where the best open start of a window reaches its full length.
    Nodes are numbered for good; those before `root`, the last settled one, are forgotten.
    There are millions of them while little is settled, so they are numbers in arrays, and
    the queue is three of them: increasing g, position, node."""

    def __init__(self, window: int = WINDOW, truncation: int = TRUNCATION_COST):
        self.window, self.truncation = window, truncation
        self.at, self.back, self.root = array("q", [0]), array("q", [-1]), 0
        self.queue = np.zeros((3, 1), np.int64)

    def add(self, places, costs) -> None:
        """places: increasing positions, after all those before, at which a window may end; costs: what a cut there costs."""
        places, costs = np.asarray(places, np.int64), np.asarray(costs, np.int64)
        done = 0
        while done < len(places):
            g, p, _ = self.queue
            # a new node costs a window more than its start, so those that cost less than that over the front all stay fronts in turn
            p = p[: np.searchsorted(g, g[0] + self.window)]
            upto = int(np.searchsorted(places, p[-1] + self.window, "right"))
            if upto > done:
                self._run(p, places[done:upto], costs[done:upto])
                done = upto
            else:
                self._far(int(places[done]), int(costs[done]))
                done += 1

    def _run(self, p: np.ndarray, places: np.ndarray, costs: np.ndarray) -> None:
        """Places whose best starts are all among the queue's first, at the positions p."""
        g, _, node = self.queue
        front = np.searchsorted(p, places - self.window)
        gone = int(front[-1])
        new = np.stack([g[front] + (self.window + costs), places, node[front]])
        # a start that a place leaves behind is cut at its full window, unless the cut at that place costs no more
        first = np.searchsorted(front, np.arange(gone), "right")
        full = g[:gone] + (self.window + self.truncation)
        less = np.flatnonzero(full < new[0, first])
        new = np.insert(new, first[less], [full[less], p[less] + self.window, node[less]], axis=1)
        number = self.root + len(self.at) + np.arange(new.shape[1])
        self.at.frombytes(new[1].tobytes())
        self.back.frombytes(new[2].tobytes())
        new[2] = number
        low = np.minimum.accumulate(new[0, ::-1])[::-1]
        stays = np.append(new[0, :-1] < low[1:], True)
        self.queue = np.concatenate([self.queue[:, gone : np.searchsorted(g, low[0])], new[:, stays]], axis=1)

    def _far(self, place: int, extra: int) -> None:
        """A place beyond the windows of those starts: each start that it leaves behind, truncated ones too, is cut at its full window."""
        queue = deque(zip(*self.queue.tolist(), strict=True))

        def push(g: int, p: int, i: int) -> None:
            while queue and queue[-1][0] >= g:
                queue.pop()
            queue.append((g, p, self.root + len(self.at)))
            self.at.append(p)
            self.back.append(i)

        while queue[0][1] < place - self.window:
            g, p, i = queue.popleft()
            push(g + self.window + self.truncation, p + self.window, i)
        g, _, i = queue[0]
        push(g + self.window + extra, place, i)
        self.queue = np.array(queue, np.int64).T

    def _forget(self, root: int) -> list[int]:
        cuts, node = [], root
        while node > self.root:
            cuts.append(self.at[node - self.root])
            node = self.back[node - self.root]
        del self.at[: root - self.root], self.back[: root - self.root]
        self.root = root
        return cuts[::-1]

    def settled(self) -> list[int]:
        """The cuts that all open starts share, which no later place can change; they are forgotten here."""
        heap = (-self.queue[2]).tolist()
        heapq.heapify(heap)
        seen = set(heap)
        while len(heap) > 1:
            up = -self.back[-heapq.heappop(heap) - self.root]
            if up not in seen:
                seen.add(up)
                heapq.heappush(heap, up)
        return self._forget(-heap[0])

    def best(self) -> list[int]:
        """The cuts up to the best last one; what was open otherwise is given up."""
        self.queue = self.queue[:, :1]
        return self._forget(int(self.queue[2, 0]))


def tail_cuts(n: int, truncation: int = TRUNCATION_COST) -> list[int]:
    """Ends of the last sequences, n tokens in all, n <= WINDOW: one padded sequence, or
    sequences of a power of two each, which need no padding, where their cuts cost less."""
    if n == 0:
        return []
    bits = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    return np.cumsum(bits).tolist() if (len(bits) - 1) * truncation < WINDOW - n else [n]


class Stream:
    """The open end of a partition's token stream.  Its cuts don't depend on how documents are grouped into feeds."""

    def __init__(self, base: int):
        self.next, self.cuts, self.gone, self.end, self.ask = base, Cuts(), 0, 0, GATHER  # tokens: those gone, all so far, when to ask
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple] = []  # (id, tokens of the document, its tokens before this stream's first, tokens here)

    def feed(self, names: list, ids: np.ndarray, begin: np.ndarray, sentence_end: np.ndarray) -> list[tuple]:
        """Adds documents, whose ids begin at `begin` (their end too); returns the pieces of all sequences that are settled."""
        cuts = []
        if names:
            fresh = np.insert(ids, begin[1:], END_ID).astype("<u4", copy=False)
            stops = begin[1:] + np.arange(1, len(names) + 1)
            sizes = (np.diff(begin) + 1).tolist()
            self.docs += [(name, n, 0, n) for name, n in zip(names, sizes, strict=True)]
            self.parts.append(fresh)
            cuttable = sentence_end[fresh]
            cuttable[stops - 1] = True
            places = np.flatnonzero(cuttable) + 1
            price = np.full(len(places), SENTENCE_COST)
            price[np.searchsorted(places, stops)] = 0
            places += self.end
            self.end += len(fresh)
            at = 0
            while at < len(places):
                upto = int(np.searchsorted(places, self.ask)) + 1
                self.cuts.add(places[at:upto], price[at:upto])
                if upto <= len(places):
                    cuts += self._settle(int(places[upto - 1]))
                at = upto
        return self._pieces([c - self.gone for c in cuts]) if cuts else []

    def close(self) -> list[tuple]:
        """The pieces of the rest."""
        cuts = [c - self.gone for c in self.cuts.best()]
        return self._pieces(cuts, last=True) if self.docs else []

    def _settle(self, place: int) -> list[int]:
        """Asked at places that the stream alone decides: after as many more tokens as wait, so that waiting ones are looked at a few times."""
        cuts = self.cuts.settled()
        if place - self.cuts.at[0] > HORIZON:
            cuts += self.cuts.best()
        self.ask = place + min(max(GATHER, place - self.cuts.at[0]), HORIZON)
        return cuts

    def _pieces(self, cuts: list[int], last: bool = False) -> list[tuple]:
        """The pieces of the sequences that end at `cuts`, and with `last` of the rest."""
        stream = np.concatenate(self.parts)
        ends = np.cumsum([d[3] for d in self.docs])
        upto = cuts[-1] if cuts else 0
        if last:
            while len(stream) - upto > WINDOW:
                upto += WINDOW
                cuts.append(upto)
            cuts += [upto + x for x in tail_cuts(len(stream) - upto)]
            upto = len(stream)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        cut = np.array([0, *cuts], np.int64)
        edge = np.unique(np.concatenate([cut, starts[starts < upto]]))
        edge = edge[edge < upto]
        stop = np.append(edge[1:], upto)
        doc = np.searchsorted(starts, edge, "right") - 1
        seq = np.searchsorted(cut, edge, "right") - 1
        raw = memoryview(stream).cast("B")
        out = []
        for s, e, d, q in zip(edge.tolist(), stop.tolist(), doc.tolist(), seq.tolist(), strict=True):
            name, total, before, _ = self.docs[d]
            out.append((name, before + s - int(starts[d]), e - s, zlib.crc32(raw[4 * s : 4 * e]), total, self.next + q, s - int(cut[q])))
        self.next += len(cuts)
        first = int(np.searchsorted(ends, upto, "right"))
        kept = self.docs[first:]
        if kept and starts[first] < upto:
            name, total, before, here = kept[0]
            gone = upto - int(starts[first])
            kept[0] = (name, total, before + gone, here - gone)
        self.docs, self.parts, self.gone = kept, [stream[upto:].copy()], self.gone + upto
        return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text (null: none) and END_ID.  Each partition of the input
    packs its own documents in their order, so nothing is shuffled and a lost task, run
    again over the same rows, gives the same sequences, whatever the size of Arrow batches;
    sequence_id counts from the partition's number times 2**40.  Repeated rows and null ids
    are documents like others, and a very long one spans many sequences.  An empty table has
    no pieces.  A cut at a sentence end costs one token of padding, so a document that would
    fit one sequence is often cut there.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        tok = tokenizer(path)
        ends = np.zeros(max(tok.tokens) + 2, bool)
        ends[[i for i, t in tok.tokens.items() if t.removesuffix(tok.end)[-1:] in (".", "!", "?", "…")]] = True
        stream = Stream(TaskContext.get().partitionId() << 40)
        id_type = None

        def rows(found):
            cols = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in slices(batch, 1, SLICE):
                if found := stream.feed(part.column(0).to_pylist(), *tok.encode_column(part.column(1)), ends):
                    yield rows(found)
        if id_type is not None and (found := stream.close()):
            yield rows(found)

    return docs.select(*numbered([id_col, text_col])).mapInArrow(tidy(run), f"`{id_col}` {kind}, {SCHEMA}")
