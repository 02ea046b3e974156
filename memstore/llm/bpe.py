"""BPE encoding and decoding (operator 8).

Method: a pair occurrence index.  All distinct chunks that a partition meets for the first
time are laid end to end in one symbol array; an index maps each adjacent pair that is a
merge to all its positions there.  Active ranks are taken in ascending order from a heap;
a rank is applied at all its positions at once (left to right where occurrences overlap),
and only the index lists of the touched neighbours are updated.  Chunks (runs without
white space of ASCII; the pre-tokenizer parts at any other) are independent under this
vocabulary's pre-tokenizer, so a chunk that came before is looked up, once for all its
places in a slice, and the ids of a text are the ids of its chunks in order.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from memstore.llm.common import numbered, tidy

#: Distinct chunks that a worker remembers; when there are more, it forgets those that the present slice doesn't use.
CACHE_CHUNKS = 300_000
#: Text of one slice of a batch, in characters.
SLICE_CHARS = 2_000_000

#: Stands for the end of a chunk among ids.
_BREAK = b"\xff\xff\xff\xff"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class PairIndexBpe:
    """A tokenizer file of kind BPE with word ends, read once per worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.end = model["end_of_word_suffix"] or ""
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"], regex.V0)
        self.words_or_breaks = regex.compile("\n|" + split["pattern"]["Regex"], regex.V0)
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.letters = byte_letters()
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.left, self.right = [self.vocab[a] for a, _ in pairs], [self.vocab[b] for _, b in pairs]
        self.made = [self.vocab[a + b] for a, b in pairs]
        key = np.array(self.left, np.int64) << 20 | np.array(self.right, np.int64)
        self.key_rank = np.argsort(key)
        self.keys = key[self.key_rank]
        self.symbol, self.last_symbol = np.full(0x200, -1, np.int64), np.full(0x200, -1, np.int64)
        for c in self.letters:
            self.symbol[ord(c)], self.last_symbol[ord(c)] = self.vocab[c], self.vocab[c + self.end]
        self.table = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.cache: dict[str, bytes] = {}
        self.known_words: dict[str, bytes] = {}

    # -- chunks ---------------------------------------------------------------

    def pieces(self, chunk: str) -> list[str | int]:
        """The pre-tokens of a chunk; a special token is its id."""
        out: list[str | int] = []
        at = 0
        for m in self.specials.finditer(chunk):
            out += self.words.findall(lowered(chunk[at : m.start()]))
            out.append(self.special[m.group()])
            at = m.end()
        return out + self.words.findall(lowered(chunk[at:]))

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks that aren't in the cache, all together."""
        odd = [c for c in chunks if "<|" in c] if self.specials else []
        rows = {c: row for c in odd if self.specials.search(c) and (row := self.pieces(c))}
        if rows:
            chunks = [c for c in chunks if c not in rows]
        low = lowered("\n".join(chunks)).split("\n") if chunks else []
        alone = [w.isalpha() for w in low]  # a pre-token each
        whole, other = list(compress(low, alone)), [not x for x in alone]
        flat = self.words_or_breaks.findall("\n".join(compress(low, other)))
        used = {*whole, *flat, *(p for row in rows.values() for p in row if not isinstance(p, int))}
        if len(self.known_words) > CACHE_CHUNKS:
            self.known_words = {p: self.known_words[p] for p in used.intersection(self.known_words)}
        coded = self.known_words
        coded["\n"] = _BREAK
        letters = self.letters
        new = list(used.difference(coded))
        spelt = [p if p.isascii() and p.isprintable() else "".join([letters[b] for b in p.encode("utf-8", "surrogatepass")]) for p in new]
        coded.update(zip(new, self.merge_all(spelt), strict=True))
        for c, row in rows.items():
            self.cache[c] = b"".join([np.uint32(p).tobytes() if isinstance(p, int) else coded[p] for p in row])
        self.cache.update(zip(compress(chunks, alone), map(coded.__getitem__, whole), strict=True))
        if any(other):
            raw = b"".join([coded[p] for p in flat])
            ends = (4 * np.flatnonzero(np.frombuffer(raw, "<u4") == 0xFFFFFFFF)).tolist() + [len(raw)]
            starts = [0, *(e + 4 for e in ends[:-1])]
            self.cache.update(zip(compress(chunks, other), [raw[x:y] for x, y in zip(starts, ends, strict=True)], strict=True))

    def merge_all(self, words: list[str]) -> list[bytes]:
        """Token ids of each word, little-endian 32-bit, by the pair occurrence index.

        Position 0 and the position after each word hold -1, so that every symbol has two
        neighbours.  index: rank -> arrays of positions whose pair had that rank when listed;
        a listed position that has changed since is skipped when its rank comes up.
        """
        if not words:
            return []
        code = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), "<u4")
        gap = code == 10
        sym = np.where(np.append(gap[1:], True), self.last_symbol[code], self.symbol[code])
        sym[gap] = -1
        n = len(sym)
        starts = (np.flatnonzero(gap)[:-1] + 1).tolist()
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> None:
            rank = self.ranks_of(left, right)
            there = rank >= 0
            rank, at = rank[there], at[there]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cut = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            for x, y in zip(cut, cut[1:], strict=False):
                r = int(rank[x])
                if r in index:
                    index[r].append(at[x:y])
                else:
                    index[r] = [at[x:y]]
                    heapq.heappush(heap, r)

        pairs = np.flatnonzero((sym[:-1] >= 0) & (sym[1:] >= 0))
        enter(sym[pairs], sym[pairs + 1], pairs)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            a, b, made = self.left[r], self.right[r], self.made[r]
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            at = at[sym[at] == a]
            j = nxt[at]
            fits = sym[j] == b
            at, j = at[fits], j[fits]
            if a == b and len(at) > 1 and np.isin(at, j).any():
                free, keep = -1, []
                for i, k in zip(at.tolist(), j.tolist(), strict=True):  # of overlapping pairs the left one is taken
                    keep.append(i != free)
                    free = k if i != free else -1
                at, j = at[keep], j[keep]
            if not len(at):
                continue
            k = nxt[j]
            sym[at], sym[j] = made, -2
            nxt[at] = k
            prv[k] = at
            h = prv[at]
            both = np.concatenate([h, at])
            left, right = sym[both], sym[np.concatenate([at, k])]
            inside = (left >= 0) & (right >= 0)
            enter(left[inside], right[inside], both[inside])
        keep = sym >= 0
        raw = sym[keep].astype("<u4").tobytes()
        upto = np.concatenate([[0], np.cumsum(keep)])[starts + [n]].tolist()
        return [raw[4 * x : 4 * y] for x, y in zip(upto, upto[1:], strict=False)]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where there is none."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], -1)

    # -- texts ----------------------------------------------------------------

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column of strings, end to end, and n+1 numbers: where each text's begin.  A null is empty."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        begin = split.offsets.to_numpy()
        coded = split.values.slice(begin[0], begin[-1] - begin[0]).dictionary_encode()
        used = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.cache) > CACHE_CHUNKS:
            self.cache = {c: self.cache[c] for c in used if c in self.cache}
        known = self.cache
        new = [c for c in used if c not in known]
        if new:
            self.learn(new)
        raw = list(map(known.__getitem__, used))
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        ids = np.frombuffer(b"".join(raw), "<u4")
        at = coded.indices.to_numpy()
        size, first = size[at], (np.cumsum(size) - size)[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        place = np.repeat((first - ends[:-1]).astype(kind), size)
        place += np.arange(ends[-1], dtype=kind)
        return ids[place], ends[begin - begin[0]]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        ids, at = self.encode_column(pa.array(texts, pa.string()))
        raw, at = ids.tobytes(), (4 * at).tolist()
        return [raw[x:y] for x, y in zip(at, at[1:], strict=False)]

    def decode_ids(self, ids: bytes) -> str:
        """Tokens joined by blanks: this vocabulary names no decoder."""
        return " ".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def lowered(text: str) -> str:
    """NFC, then each character's lower case by itself (no final sigma)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


def text_slices(texts: list, limit: int = SLICE_CHARS):
    """(first row, texts with nulls as empty), cut so that a slice has few characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield at, [x or "" for x in texts[at : i + 1]]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, [x or "" for x in texts[at:]]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: str = "digest") -> DataFrame:
    """Encodes every text and decodes the ids again.

    keep="digest": (id, n_tokens, ids_sha256, decoded_sha256); keep="full": (id, ids
    array<long>, decoded).  A null or empty text has no ids and decodes to "".  Rows are
    independent, so repeated rows and null ids come back as they are; other columns are
    left out.  No shuffle; a lost task is simply run again.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    full = keep == "full"
    schema = f"`{id_col}` {kind}, " + ("ids array<long>, decoded string" if full else "n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, some in text_slices(texts):
                ids = tok.encode_many(some)
                if full:
                    cols = [pa.array([np.frombuffer(x, "<u4").tolist() for x in ids], pa.list_(pa.int64())), pa.array([tok.decode_ids(x) for x in ids], pa.string())]
                else:
                    cols = [
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(tok.decode_ids(x).encode()).hexdigest() for x in ids], pa.string()),
                    ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), *cols], names=[id_col, *(["ids", "decoded"] if full else ["n_tokens", "ids_sha256", "decoded_sha256"])])

    return docs.select(*numbered([id_col, text_col])).mapInArrow(tidy(run), schema)
