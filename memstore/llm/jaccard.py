"""N-gram Jaccard join (operator 2).

Method: documents meet in size-banded tiles and are compared there by hashed bitmaps whose
bit counts bound the overlap from above; what remains is decided by exact intersection of
sorted shingle arrays.  A tile is one shingle of the documents' prefixes: of two sets whose
Jaccard similarity reaches t, the first common shingle in any fixed order stands among the
first n - ceil(t n) + 1 of each set of n.

The order is by document frequency, counted over all documents, so a passage that many
documents share comes last.  A shingle of one document is in no intersection: documents
with more than n - ceil(t n) of those link with nothing and go no further, and of the others
only the shared shingles are kept.  A shingle that more than OFTEN documents of one chunk
hold is not gathered anywhere: its documents learn that it is shared where they stand.

Only components are asked for, so links inside a component already known needn't be found.
First each document is compared with the hub (least document) that it shares most tiles
with; then with its best partner of another component in each tile; then what is left.
Tiles with the same documents count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memstore.llm.common import KEY, Scratch, components, kept_columns, keyed, mix64, prefix_hash, quoted, slices, span_hash, tidy, utf8

WORDS, PERCENT = 5, 75
#: Bytes of text in a chunk; documents of a chunk above which a shingle counts as frequent everywhere.
CHUNK, OFTEN = 8_000_000, 16
#: Shingles of a bucket on average, least number of buckets.
BUCKET, BUCKETS = 1_000_000, 256
#: Shared entries that a task gathers before it passes them on.
HELD = 500_000
#: Order of frequent shingles; others have the logarithm of their document frequency, in eighths.
LAST = 255
#: Documents of one side of a tile, and of one comparison with a hub.
BLOCK = 1024
#: Bytes of text worked on at a time.
SLICE = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and the first word's index of each text (n + 1)."""
    low = _LOWER[data]
    space = _SPACE[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(~space & (np.append(True, space[:-1]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    stop = np.flatnonzero(~space & (np.append(space[1:], True) | edge[1:])) + 1 if len(data) else start
    return span_hash(prefix_hash(low), start, stop), np.searchsorted(start, off)


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int = WORDS):
    """The sorted distinct shingle hashes of each text, as a generator."""
    w, at = word_hashes(data, off)
    mul = np.uint64(0xC2B2AE3D27D4EB4F)
    m = max(0, len(w) - words + 1)
    acc = w[:m].copy()
    for j in range(1, words):
        acc = acc * mul + w[j : j + m]
    acc = mix64(acc)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(acc[a : b - words + 1])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = mix64(whole * mul + w[k : k + 1])
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def bitmap(s: np.ndarray) -> bytes:
    """Parity bitmap of a set: the least power of two bits that is >= 2n and >= 64.  The bits in
    which two of them differ are at most as many as the elements in which the sets do."""
    width = max(64, 1 << (2 * max(len(s), 1) - 1).bit_length())
    bits = np.bincount((s >> np.uint64(3)).astype(np.int64) & (width - 1), minlength=width).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Parity bitmaps (rows of 64-bit words) folded to a smaller width in words."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def overlap_bound(ka, kb, a: np.ndarray, b: np.ndarray):
    """An upper bound of the intersection of sets of ka and kb elements, from their bitmaps (rows of one width)."""
    return (ka + kb - np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)) // 2


def linked(common, na, nb, percent: int = PERCENT):
    return 100 * common >= percent * (na + nb - common)


class _Chunk:
    """Shingles of some documents, to be dealt to buckets."""

    def __init__(self, buckets: int):
        self.bits, self.docs, self.sizes, self.sets, self.bytes = buckets.bit_length() - 1, [], [], [], 0

    def add(self, doc: int, s: np.ndarray) -> None:
        if len(s):
            self.docs.append(doc)
            self.sizes.append(len(s))
            self.sets.append(s)

    def rows(self):
        """(bucket, shingles, their documents by number, documents, set sizes) as columns; a bucket
        below 0 holds frequent shingles, whose bucket gets a mark instead."""
        if not self.docs:
            return
        docs, sizes = np.array(self.docs, np.int64), np.array(self.sizes, np.int32)
        h = np.concatenate(self.sets)
        own = np.repeat(np.arange(len(docs), dtype=np.uint32), sizes)
        order = np.argsort(h)
        h, own = h[order], own[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        count = np.diff(np.append(first, len(h)))
        often = count > OFTEN
        if often.any():
            hot = np.repeat(often, count)
            yield self._batch(np.array([-1 - int(docs[0]) % 1024]), h[hot], own[hot], np.array([0, hot.sum()]), docs, sizes)
            stay = ~hot
            stay[first[often]] = True
            own[first[often]] = len(docs)
            h, own = h[stay], own[stay]
        bucket = (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        yield self._batch(bucket[cut], h, own, np.append(cut, len(h)), np.append(docs, 0), np.append(sizes, np.int32(0)))
        self.docs, self.sizes, self.sets, self.bytes = [], [], [], 0

    @staticmethod
    def _batch(bucket, h, own, cut, docs, sizes) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], []]
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            used, at = np.unique(own[s:e], return_inverse=True)
            for col, v in zip(cols, (planes(h[s:e]), at.astype(np.uint32 if len(used) > 65536 else np.uint16).tobytes(), planes(np.diff(docs[used], prepend=0)), planes(sizes[used])), strict=True):
                col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], names=["bucket", "h", "at", "docs", "sizes"])


def planes(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: of sorted hashes, and of near numbers, the high ones repeat, so they take little room."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def from_planes(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _sizes(words: int):
    """n and two sums of each document's set; equal sets have equal ones."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                n, s1, s2 = [], [], []
                for s in shingle_sets(*utf8(part.column(1)), words):
                    n.append(len(s))
                    s1.append(int(mix64(s + np.uint64(1)).sum(dtype=np.uint64)))
                    s2.append(int(np.bitwise_xor.reduce(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) if len(s) else 0))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64))], names=[KEY, "n", "s1", "s2"])

    return run


def _deal(words: int, buckets: int):
    def run(batches):
        chunk = _Chunk(buckets)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                data, off = utf8(part.column(1))
                for doc, s in zip(part.column(0).to_pylist(), shingle_sets(data, off, words), strict=True):
                    chunk.add(doc, s)
                chunk.bytes += len(data)
                if chunk.bytes >= CHUNK:
                    yield from chunk.rows()
        yield from chunk.rows()

    return run


def _by_key(batches, columns: tuple[int, ...] = (0,)):
    """The rows of each value of some columns, by which they come sorted, as tables."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, t]) if held is not None else t
        if not held.num_rows:
            continue
        keys = [held.column(c).to_numpy() for c in columns]
        cut = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield held.slice(s, e - s)
        held = held.slice(int(cut[-1]))
    if held is not None and held.num_rows:
        yield held


def _shared(groups: int):
    """The shared shingles of buckets: (group of documents, documents, set sizes, entries of each, shingles, order)."""

    def entries(t: pa.Table):
        own = [np.cumsum(from_planes(x, np.int64)) for x in t.column("docs").to_pylist()]
        size = [from_planes(x, np.int32) for x in t.column("sizes").to_pylist()]
        h = [from_planes(x, np.uint64) for x in t.column("h").to_pylist()]
        at = [np.frombuffer(x, np.uint32 if len(d) > 65536 else np.uint16) for x, d in zip(t.column("at").to_pylist(), own, strict=True)]
        doc = np.concatenate([d[a] for d, a in zip(own, at, strict=True)])
        n = np.concatenate([d[a] for d, a in zip(size, at, strict=True)])
        h = np.concatenate(h)
        if t.column("bucket")[0].as_py() < 0:
            return doc, n, h, np.full(len(h), LAST, np.uint8)
        order = np.argsort(h)
        h, doc, n = h[order], doc[order], n[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        count = np.diff(np.append(first, len(h)))
        marked = np.add.reduceat(n == 0, first) > 0  # a mark has no set size
        level = np.where(marked, LAST, np.minimum(8 * np.log2(count), LAST - 1)).astype(np.uint8)
        level = np.repeat(level, count)
        keep = np.repeat((count > 1) | marked, count) & (n > 0)
        return doc[keep], n[keep], h[keep], level[keep]

    def packed(some: list):
        doc, n, h, level = (np.concatenate([x[i] for x in some]) for i in range(4))
        group = (mix64(doc.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((doc, group))
        doc, n, h, level, group = doc[order], n[order], h[order], level[order], group[order]
        fresh = np.append(True, doc[1:] != doc[:-1])
        cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        cols: list[list] = [[], [], [], [], []]
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(doc)], strict=True):
            f = np.flatnonzero(fresh[s:e])
            for col, v in zip(cols, (doc[s:e][f], n[s:e][f], np.diff(np.append(f, e - s)).astype(np.int32), h[s:e], level[s:e]), strict=True):
                col.append(v.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(group[cut], pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], names=["group", "docs", "sizes", "counts", "h", "level"])

    def run(batches):
        some, held = [], 0
        for t in _by_key(batches):
            found = entries(t)
            some.append(found)
            held += len(found[0])
            if held >= HELD:
                yield packed(some)
                some, held = [], 0
        if held:
            yield packed(some)

    return run


def _sets(percent: int):
    """Documents that can link: KEY, n, their shared shingles (sorted), bitmap, prefix tiles and those tiles' ranks."""

    def run(batches):
        for t in _by_key(batches):
            read = lambda c, kind: [np.frombuffer(x, kind) for x in t.column(c).to_pylist()]  # noqa: B023, E731
            counts = np.concatenate(read("counts", np.int32))
            doc, n = (np.repeat(np.concatenate(read(c, k)), counts) for c, k in (("docs", np.int64), ("sizes", np.int32)))
            h, level = np.concatenate(read("h", np.uint64)), np.concatenate(read("level", np.uint8))
            order = np.lexsort((h, level, doc))
            doc, n, h = doc[order], n[order], h[order]
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            out = []
            for s, e in zip(first.tolist(), [*first[1:].tolist(), len(doc)], strict=True):
                size, shared = int(n[s]), e - s
                alone = size - shared
                p = prefix_length(size, percent) - alone
                if p > 0:
                    own = np.sort(h[s:e])
                    out.append((int(doc[s]), size, own.tobytes(), bitmap(own), h[s : s + p].view(np.int64), np.arange(alone, alone + p, dtype=np.int32)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[KEY, "n", "shared", "bits", "prefix", "ranks"])

    return run


def _verify(percent: int):
    """Links (a, b) of rows (hub, salt, role, doc, n, shared): the hub, role 0, comes before the documents compared with it."""

    def run(batches):
        hub = None
        for batch in batches:
            a, b = [], []
            for role, doc, n, raw in zip(*(batch.column(c).to_pylist() for c in ("role", "doc", "n", "shared")), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if role == 0:
                    hub = doc, n, s
                elif linked(len(np.intersect1d(s, hub[2], assume_unique=True)), n, hub[1], percent):
                    a.append(doc)
                    b.append(hub[0])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _tile_pairs(percent: int, best: bool):
    """Pairs of different components that the bounds of a tile allow; with `best` one for each document, that of the greatest bound.

    Rows come sorted by (key, band, i, j).  Bounds of the overlap: the bit counts, and the places
    in the common order: before the shared shingle lie min(i, j) common ones at most, after
    it as many as the shorter rest."""

    def settle(t: pa.Table):
        doc, n, comp, own, block, rank = (t.column(c).to_numpy() for c in ("doc", "n", "comp", "own", "block", "rank"))
        maps = t.column("bits").to_pylist()
        width = min(len(x) for x in maps) // 8
        bits = np.concatenate([folded(np.frombuffer(x, np.uint64)[None], width) for x in maps])
        shared = t.column("k").to_numpy()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        rows = np.arange(len(doc))
        one, other = (rows, rows) if i == j else (rows[block == i], rows[block != i])
        found_x, found_y, bounds = [], [], []
        for at, x in enumerate(one.tolist()):
            y = other[at + 1 :] if i == j else other
            lo, hi = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            y = y[(comp[x] != comp[y]) & (100 * lo >= percent * hi) & ((own[x] == 0) | (own[y] == 0))]
            if not len(y):
                continue
            bound = np.minimum(overlap_bound(shared[x], shared[y], bits[x], bits[y]), np.minimum(rank[x], rank[y]) + np.minimum(n[x] - rank[x], n[y] - rank[y]))
            ok = linked(bound, n[x], n[y], percent)
            found_x.append(np.full(int(ok.sum()), x))
            found_y.append(y[ok])
            bounds.append(bound[ok])
        if not found_x:
            return np.zeros((2, 0), np.int64)
        x, y, bound = np.concatenate(found_x), np.concatenate(found_y), np.concatenate(bounds)
        if best:
            both, score = np.concatenate([x, y]), np.concatenate([bound, bound])
            order = np.lexsort((-score, both))
            first = order[np.append(True, both[order][1:] != both[order][:-1])] if len(order) else order
            pick = np.unique(first % max(len(x), 1))
            x, y = x[pick], y[pick]
        return np.stack([np.maximum(doc[x], doc[y]), np.minimum(doc[x], doc[y])])

    def run(batches):
        some, held = [], 0
        for t in _by_key(batches, (0, 1, 2, 3)):
            some.append(settle(t))
            held += some[-1].shape[1]
            if held >= HELD:
                pair = np.unique(np.concatenate(some, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])
                some, held = [], 0
        if held:
            pair = np.unique(np.concatenate(some, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    return run


def _linked_sets(docs: DataFrame, total: int, words: int, percent: int) -> DataFrame:
    """What _sets gives of all documents, through buckets of shingles and groups of documents."""
    buckets = max(BUCKETS, 1 << max(0, (total // BUCKET).bit_length()))
    dealt = docs.select(KEY, "__text").mapInArrow(tidy(_deal(words, buckets)), "bucket long, h binary, at binary, docs binary, sizes binary")
    found = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_shared(buckets)), "group long, docs binary, sizes binary, counts binary, h binary, level binary")
    return found.repartition("group").sortWithinPartitions("group").mapInArrow(tidy(_sets(percent)), f"{KEY} long, n long, shared binary, bits binary, prefix array<long>, ranks array<int>")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, keep: list[str] = ()) -> DataFrame:
    """id, n_shingles, component_id, kept and the columns of `keep`; one row for each input row.

    A set holds the distinct runs of `words` lower-cased words; a text of fewer words is one
    run, an empty or null text has an empty set and links with nothing.  Sets link when
    100 * intersection >= percent * union.  Repeated and null ids: each row is a document of
    its own, and component_id is the least id in the component.  An empty table has no rows.
    Columns of `keep` that are named like a result are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    keep = kept_columns(keep, [id_col, "n_shingles", "component_id", "kept"])
    docs = keyed(docs, id_col, [c for c in dict.fromkeys([text_col, *keep]) if c != id_col], scratch)
    docs = docs.select(KEY, F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), F.struct(F.lit(0).alias("__"), *quoted(keep)).alias("__keep"))
    per = scratch.table(docs.select(KEY, "__text").mapInArrow(tidy(_sizes(words)), f"{KEY} long, n long, s1 long, s2 long"), "sizes")
    classes = per.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(KEY).alias("rep"))
    rep_of = scratch.table(per.where("n > 0").select(KEY, "n", "s1", "s2").join(classes, ["n", "s1", "s2"]).select(KEY, "rep"), "classes")
    total = per.agg(F.sum("n")).first()[0] or 0
    every = scratch.table(_linked_sets(docs, total, words, percent), "linkable")
    sets = scratch.table(every.join(rep_of.where(F.col(KEY) == F.col("rep")).select(KEY), KEY, "left_semi"), "sets")
    scratch.drop(every)

    # tile rows: (shingle of the prefix, document, its place) where two documents share the shingle
    rows = sets.select(F.col(KEY).alias("doc"), "n", F.explode(F.arrays_zip("prefix", "ranks")).alias("p")).select("doc", "n", F.col("p.prefix").alias("key"), F.col("p.ranks").alias("rank"))
    hubs = rows.groupBy("key").agg(F.min("doc").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
    rows = scratch.table(rows.join(hubs, "key"), "tiles")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The linked ones of some pairs (a, b).  What is compared with one b is dealt to tasks by BLOCK, each with b's set once."""
        held = sets.select(F.col(KEY).alias("doc"), "n", "shared")
        many = pairs.groupBy(F.col("b").alias("hub")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
        members = pairs.withColumnRenamed("b", "hub").join(many, "hub").select("hub", F.pmod(F.xxhash64("a"), F.col("nb")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("a").alias("doc"))
        own = many.select("hub", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("hub").alias("doc"))
        both = members.unionByName(own).join(held, "doc").select("hub", "salt", "role", "doc", "n", "shared")
        both = both.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")
        return scratch.table(both.mapInArrow(tidy(_verify(percent)), "a long, b long"), name)

    stars = rows.where("doc <> hub").groupBy("doc", "hub").agg(F.count("*").alias("c"))
    stars = stars.groupBy("doc").agg(F.max_by("hub", F.struct("c", -F.col("hub"))).alias("hub"))
    links = verified(scratch.table(stars.select(F.col("doc").alias("a"), F.col("hub").alias("b")), "hubs"), "stars")
    comp = components(links, scratch)

    # what is left: tiles of a size band that hold several components, one of those with the same documents
    def known(rows: DataFrame) -> DataFrame:
        return rows.join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")

    whole = rows.select("key", "doc", "n", "rank")
    rows = known(whole)
    mixed = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    rows = rows.join(mixed, "key").withColumn("top", band).select("*", F.explode(F.array(F.col("top"), F.col("top") - 1)).alias("band")).withColumn("own", (F.col("top") - F.col("band")).cast("int")).drop("top")
    rows = scratch.table(rows, "banded")
    tiles = rows.groupBy("key", "band").agg(F.count("*").alias("c"), F.count_if(F.col("own") == 0).alias("mine"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.bit_xor(F.xxhash64("doc")).alias("h1"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("h2"))
    tiles = tiles.where("mine > 0 and c > 1 and x <> y").groupBy("band", "c", "h1", "h2").agg(F.min("key").alias("key"))
    tiles = tiles.select("key", "band", F.ceil(F.col("c") / BLOCK).cast("int").alias("nb"))
    rows = rows.drop("comp").join(tiles, ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("nb")).cast("int"))
    rows = scratch.table(rows, "meeting")
    maps = sets.select(F.col(KEY).alias("doc"), (F.length("shared") / 8).cast("long").alias("k"), "bits")

    def met(best: bool, name: str) -> DataFrame:
        own = known(rows)
        mixed = own.groupBy("key", "band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key", "band")
        own = own.join(mixed, ["key", "band"]).join(maps, "doc")
        parts = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
        own = own.select("*", F.explode(parts).alias("t")).select("key", "band", "t.i", "t.j", "doc", "n", "k", "comp", "own", "block", "rank", "bits")
        own = own.repartition("key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j")
        return scratch.table(own.mapInArrow(tidy(_tile_pairs(percent, best)), "a long, b long").distinct(), name)

    for best, name in ((True, "best"), (False, "rest")):
        links = links.unionByName(verified(met(best, name), f"{name}-links"))
        comp = components(links, scratch)

    out = per.select(KEY, "n").join(rep_of, KEY, "left").join(comp, F.col("rep") == F.col("node"), "left").select(KEY, "n", F.coalesce("component", "rep", KEY).alias("__c"))
    least = docs.select(KEY, "__id").join(out, KEY).groupBy("__c").agg(F.min("__id").alias("component_id"))
    out = scratch.only(out.join(least, "__c"), "result")
    out = docs.select(KEY, "__id", "__keep").join(out, KEY)
    return out.select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col(KEY) == F.col("__c")).alias("kept"), *[F.col(f"__keep.`{c}`").alias(c) for c in keep])
