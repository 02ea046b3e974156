"""Suffix-array dedup (operator 5).

Finds every byte covered by a string of LENGTH bytes that starts in two places or more.

Method: difference-cover blockwise construction.  Suffixes fall into buckets by the least
hash of the 32-byte strings in their first LENGTH bytes (a value that equal prefixes share);
a run of neighbouring suffixes of one bucket is a block.  A bucket that occurs once, with
the string of that hash once in it, holds no repeat, and a block whose whole text occurs twice is all repeats: both are settled by counts.
Only the distinct blocks of the other buckets are sorted, a bounded set of buckets at a time:
by their first PERIOD bytes, and where those tie by the ranks of difference-cover samples,
found beforehand by prefix doubling.  Neighbours in the order are compared byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memstore.llm.common import BYTE_CODE, KEY, Scratch, fields, give_back, kept_columns, keyed, mix64, numbered, prefix_hash, slices, span_hash, tidy, utf8

LENGTH = 200
#: Bytes of the strings whose least hash names the bucket.
SEED = 32
#: Most suffixes in a block.
RUN = 256
#: Blocks sorted at a time.  Buckets of more distinct blocks are split by the bytes that STEP
#: neighbouring prefixes share, and if that leaves more, by whole prefixes.
GROUP_BLOCKS, BUCKET_BLOCKS, STEP = 4000, 4000, 16
#: Period of the difference cover and the cover: every difference mod 31 occurs once.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
SLICE = 1_000_000


def _shifts() -> np.ndarray:
    """shift[r, s]: a d < PERIOD with both r + d and s + d in the cover, mod PERIOD."""
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    for r in range(PERIOD):
        for s in range(PERIOD):
            out[r, s] = next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER)
    return out


SHIFT = _shifts()


def _slide(x: np.ndarray, want: int, least: np.ufunc) -> np.ndarray:
    """least(x[i : i + want]) for each i."""
    span = 1
    n = len(x) - want + 1
    while span * 2 <= want:
        x = least(x[:-span], x[span:])
        span *= 2
    return least(x[:n], x[want - span : want - span + n])


def buckets_of(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the SEED bytes at each place, and for each place the least of those in the next `length` bytes."""
    h = BYTE_CODE[data]
    span = 1
    mul = 0x9FB21C651E98DF25
    while span < SEED:
        h = h[:-span] * np.uint64(mul) + h[span:]
        mul = mul * mul % 2**64 | 1
        span *= 2
    h = mix64(h)
    return h, _slide(h, length - SEED + 1, np.minimum)


def _least_twice(h: np.ndarray, bucket: np.ndarray, first: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Which blocks hold their bucket's seed in two places, as they must to repeat a prefix within themselves."""
    want = length - SEED + 1
    padded = np.concatenate([np.zeros(want - 1, np.uint64), bucket, np.zeros(want - 1, np.uint64)])
    seed = np.flatnonzero(_slide(padded, want, np.maximum) == h)
    value = h[seed]
    a, b = np.searchsorted(seed, first), np.searchsorted(seed, first + n + want - 1)
    count = np.zeros(len(first), np.int8)
    live = np.flatnonzero(a < b)
    while len(live):
        count[live] += value[a[live]] == bucket[first[live]]
        a[live] += 1
        live = live[(a[live] < b[live]) & (count[live] < 2)]
    return count > 1


def blocks_of(data: np.ndarray, off: np.ndarray, length: int = LENGTH):
    """(text, first start in it, starts, bucket, hash of the block's bytes, whether it may repeat itself) of all blocks."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    h, bucket = buckets_of(data, length)
    size = np.diff(off)
    doc = np.repeat(np.arange(len(size)), size)[: len(bucket)]
    inside = np.arange(len(bucket)) + length <= off[doc + 1]
    fresh = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])) | ~inside)
    stop = np.append(fresh[1:], len(bucket))[inside[fresh]]
    at = fresh[inside[fresh]]
    pieces = -(-(stop - at) // RUN)
    first = np.repeat(at, pieces) + RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    n = np.minimum(RUN, np.repeat(stop, pieces) - first)
    twice = _least_twice(h, bucket, first, n, length)
    return doc[first], first - off[doc[first]], n, bucket[first], span_hash(prefix_hash(data), first, first + n - 1 + length), twice


def _words(x: np.ndarray, at: np.ndarray, count: int) -> list[np.ndarray]:
    """The bytes from each place on as big-endian 64-bit words."""
    wide = np.lib.stride_tricks.sliding_window_view(x, 8)
    return [np.ascontiguousarray(wide[at + 8 * k]).view(">u8").ravel().astype(np.uint64) for k in range(count)]


def _ranked(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks by the keys, the first one leading."""
    order = np.lexsort(keys[::-1])
    step = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        step[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(step)
    return out


def repeated(x: np.ndarray, at: np.ndarray, bucket: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the places `at` of x start a `length`-byte string that another one of the same bucket starts too."""
    out = np.zeros(len(at), bool)
    if len(at) < 2:
        return out
    m = len(x)
    depth = PERIOD
    while depth < length:
        depth *= 2
    x = np.concatenate([x, np.zeros(depth + 2 * PERIOD + 8 * (length // 8 + 2), np.uint8)])
    # ranks of the cover samples to at least `length` bytes: PERIOD bytes, then doubling along the sample's own residue
    sample = np.flatnonzero(np.isin(np.arange(m + PERIOD) % PERIOD, COVER))
    keys = _words(x, sample, 4)
    keys[3] &= np.uint64(0xFFFFFFFFFFFFFF00)
    rank = np.full(len(x) + depth, -1, np.int64)
    rank[sample] = _ranked(keys)
    span = PERIOD
    while span < length:
        rank[sample] = _ranked([(rank[sample] + 1 << 32) + rank[sample + span] + 1])
        span *= 2
    # suffixes by bucket and first PERIOD bytes
    keys = _words(x, at, 4)
    keys[3] &= np.uint64(0xFFFFFFFFFFFFFF00)
    group = _ranked([bucket, *keys])
    order = np.argsort(group, kind="stable")
    # ties: three-way partition of all groups at once, each by its middle suffix, comparing ranks at the common shift
    live = np.arange(len(order))
    live_group = group[order]
    while len(live):
        first = np.flatnonzero(np.append(True, live_group[1:] != live_group[:-1]))
        size = np.diff(np.append(first, len(live)))
        open_ = np.repeat(size > 1, size)
        live, live_group = live[open_], live_group[open_]
        if not len(live):
            break
        first = np.flatnonzero(np.append(True, live_group[1:] != live_group[:-1]))
        size = np.diff(np.append(first, len(live)))
        i = at[order[live]]
        j = np.repeat(i[first + size // 2], size)
        d = SHIFT[i % PERIOD, j % PERIOD]
        side = np.sign(rank[i + d] - rank[j + d])
        key = np.repeat(np.arange(len(first)) * 3, size) + side + 1
        turn = np.argsort(key, kind="stable")
        order[live] = order[live[turn]]
        key = key[turn]
        keep = key % 3 != 1
        live, live_group = live[keep], key[keep]
    a, b = order[:-1], order[1:]
    same = np.flatnonzero(group[a] == group[b])
    p, q = at[a[same]], at[b[same]]
    wide = np.lib.stride_tricks.sliding_window_view(x, 8)
    for k in range(0, length, 8):
        k = min(k, length - 8)
        eq = np.flatnonzero(np.ascontiguousarray(wide[p + k]).view(np.uint64).ravel() == np.ascontiguousarray(wide[q + k]).view(np.uint64).ravel())
        same, p, q = same[eq], p[eq], q[eq]
    out[a[same]] = True
    out[b[same]] = True
    return out


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last index of each run of true."""
    step = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _sort_group(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return found(pdf)
        finally:
            give_back()

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy().astype(np.int64)
        texts = pdf["bytes"].tolist()
        x = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum([0] + [len(t) for t in texts[:-1]])
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner = np.repeat(np.arange(len(n)), n)
        flag = repeated(x, begin[owner] + place, pdf["fp"].to_numpy()[owner], length) & pdf["edge"].to_numpy()[owner]
        # runs end where the block does
        key = owner * (RUN + 2) + place
        hit = key[flag]
        if not len(hit):
            return pd.DataFrame({KEY: pd.Series(dtype="int64"), "s": pd.Series(dtype="int64"), "e": pd.Series(dtype="int64")})
        cut = np.flatnonzero(np.append(True, np.diff(hit) != 1))
        s, e = hit[cut], hit[np.append(cut[1:], len(hit)) - 1]
        o = s // (RUN + 2)
        lo = pdf["lo"].to_numpy()[o]
        return pd.DataFrame({KEY: pdf[KEY].to_numpy()[o], "s": lo + s % (RUN + 2), "e": lo + e % (RUN + 2) + length})

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, text_col: str, length: int = LENGTH) -> DataFrame:
    """(KEY, s, e): byte ranges, perhaps overlapping, that together are all bytes to remove."""
    spark = docs.sparkSession
    n_groups = GROUP_BLOCKS

    def find(batches):
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                data, off = utf8(part.column(1))
                doc, lo, n, fp, bk, twice = blocks_of(data, off, length)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(fp.view(np.int64)), pa.array(bk.view(np.int64)), pa.array(twice)], names=[KEY, "lo", "n", "fp", "bk", "twice"])

    blocks = scratch.table(docs.select(KEY, F.col(f"`{text_col}`").alias("__text")).mapInArrow(tidy(find), f"{KEY} long, lo int, n int, fp long, bk long, twice boolean"), "blocks")
    often = blocks.groupBy("fp").agg(F.count("*").alias("c"), ((F.min("bk") == F.max("bk")) & (F.count("*") > 1)).alias("same"), F.max("twice").alias("t")).where("c > 1 or t").select("fp", "same")
    found = scratch.table(blocks.join(often, "fp"), "repeated")
    scratch.drop(blocks)
    mixed = found.where("not same")
    distinct = mixed.groupBy("fp", "bk").agg(F.count("*").alias("c"), F.min(F.struct(KEY, "lo", "n")).alias("r"))
    distinct = scratch.table(distinct.select("fp", "bk", "c", f"r.{KEY}", "r.lo", "r.n"), "distinct")
    total = distinct.count()
    whole = found.where("same").select(KEY, "lo", "n").unionByName(mixed.join(distinct.where("c > 1").select("fp", "bk"), ["fp", "bk"]).select(KEY, "lo", "n"))
    out = whole.select(KEY, F.col("lo").cast("long").alias("s"), (F.col("lo") + F.col("n") - 1 + length).cast("long").alias("e"))
    if not total:
        return scratch.only(out, "spans")
    hot = distinct.groupBy("fp").agg((F.count("*") > BUCKET_BLOCKS).alias("hot"))
    wanted = distinct.join(hot, "fp").groupBy(KEY).agg(F.collect_list(F.struct("lo", "n", "fp", (F.col("c") == 1).alias("edge"), "hot")).alias("w"))

    def cut(batches):
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                data, off = utf8(part.column(1))
                raw, rows = data.tobytes(), []
                for i, (key, want) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    base = int(off[i])
                    for w in want:
                        s = base + w["lo"]
                        text = raw[s : s + w["n"] - 1 + length]
                        if not w["hot"]:
                            rows.append((key, w["lo"], w["n"], w["fp"], w["edge"], text, None))
                            continue
                        for o, n, core in sub_blocks(np.frombuffer(text, np.uint8), w["n"], np.uint64(w["fp"] % 2**64), length):
                            own = text[o : o + n - 1 + length]
                            rows.append((key, w["lo"] + o, n, core, w["edge"], own, int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True)))
                cols = list(zip(*rows, strict=True)) or [()] * 7
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[KEY, "lo", "n", "fp", "edge", "bytes", "bk"])

    texts = docs.select(KEY, F.col(f"`{text_col}`").alias("__text")).join(wanted, KEY).select(KEY, "__text", "w")
    texts = scratch.table(texts.mapInArrow(tidy(cut), f"{KEY} long, lo int, n int, fp long, edge boolean, bytes binary, bk long"), "texts")
    span = [KEY, F.col("lo").cast("long").alias("s"), (F.col("lo") + F.col("n") - 1 + length).cast("long").alias("e")]
    # split buckets: the same steps again, on their parts
    parts = texts.where("bk is not null")
    same = parts.groupBy("fp", "bk").agg(F.count("*").alias("c"), F.min(F.struct(KEY, "lo")).alias("r"))
    parts = scratch.table(parts.join(same, ["fp", "bk"]), "parts")
    out = out.unionByName(parts.where("c > 1 and edge").select(*span))
    rest = parts.where((F.col(f"r.{KEY}") == F.col(KEY)) & (F.col("r.lo") == F.col("lo"))).withColumn("edge", F.col("edge") & (F.col("c") == 1))
    hot = rest.groupBy("fp").agg((F.count("*") > BUCKET_BLOCKS).alias("hot"))
    rest = rest.join(hot, "fp")
    columns = [KEY, "lo", "n", "fp", "edge", "bytes"]
    cold = texts.where("bk is null").select(*columns).unionByName(rest.where("not hot").select(*columns))
    groups = max(1, -(-max(total, 1) // n_groups))
    cold = cold.withColumn("g", F.pmod(F.xxhash64("fp"), F.lit(groups))).groupBy("g").applyInPandas(_sort_group(length), f"{KEY} long, s long, e long")
    # what is still too large: one sub-bucket for each whole prefix, counted
    prefix = lambda i: F.substring("bytes", i + 1, F.lit(length))
    hashes = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.xxhash64(prefix(i)).alias("h1"), F.xxhash64(prefix(i), F.lit(7)).alias("h2")))
    each = rest.where("hot").select(KEY, "lo", "edge", F.posexplode(hashes).alias("i", "h")).select(KEY, (F.col("lo") + F.col("i")).cast("long").alias("s"), "edge", "h.h1", "h.h2")
    many = each.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2")
    warm = each.where("edge").join(many, ["h1", "h2"]).select(KEY, "s", (F.col("s") + length).alias("e"))
    return scratch.only(out.unionByName(cold).unionByName(warm), "spans")


def sub_blocks(x: np.ndarray, n: int, bucket: np.uint64, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(first start, starts, hash of the shared bytes) of a block's parts.

    A start's distance to the first seed of the bucket in its prefix is part of the prefix;
    starts of one seed whose distances share a multiple of STEP make a part, named by the
    bytes that lie in all prefixes of such distances.  Equal prefixes fall in equally named parts."""
    h, _ = buckets_of(x, length)
    seed = np.flatnonzero(h == bucket)
    start = np.arange(n)
    at = seed[np.searchsorted(seed, start)]
    step = (at - start) // STEP
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (step[1:] != step[:-1])))
    out = []
    for s, e in zip(first.tolist(), [*first[1:].tolist(), n], strict=True):
        k = int(step[s]) * STEP
        lo = int(at[s]) - k
        core = x[lo : lo - STEP + 1 + length].tobytes()
        out.append((s, e - s, int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=k.to_bytes(4, "little")).digest(), "little", signed=True)))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes in some ranges."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = (), length: int = LENGTH, texts: bool = False) -> DataFrame:
    """id, the columns of `keep`, n_bytes, n_removed, n_spans, kept_sha256 and, with texts=True, kept.

    Texts are UTF-8 bytes (null: empty), matches lie within one text each, and all are
    judged on the input.  `kept` is the remaining bytes as text, without the halves of a
    character that was cut.  Columns of `keep` that are named like a result are left out.
    An empty table has no rows.  Repeated and null ids: each row is a document of its own.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    schema = docs.schema
    keep = kept_columns(keep, [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    rows = keyed(docs, id_col, [c for c in [text_col, *keep] if c != id_col], scratch)
    spans = repeated_spans(rows, scratch, text_col, length).groupBy(KEY).agg(F.collect_list(F.struct("s", "e")).alias("__spans"))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE)):
            got = []
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            for data, want in zip(raw, batch.column(2).to_pylist(), strict=True):
                data, cuts = data or b"", merged([(w["s"], w["e"]) for w in want or ()])
                at, parts = 0, []
                for s, e in cuts:
                    parts.append(data[at:s])
                    at = e
                left = b"".join([*parts, data[at:]])
                got.append((len(data), len(data) - len(left), len(cuts), hashlib.sha256(left).hexdigest(), *([left.decode("utf-8", "ignore")] if texts else [])))
            cols = list(zip(*got, strict=True)) or [()] * (4 + texts)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names=[id_col, *keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])])

    kinds = ", ".join(fields(schema, [id_col, *keep]))
    joined = rows.join(spans, KEY, "left").select(*numbered([id_col, text_col, "__spans", *keep]))
    return joined.mapInArrow(tidy(run), f"{kinds}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * texts)
