"""Suffix-array dedup of 200-byte strings by bucket-pointer refinement.

A suffix matters here for its first 200 bytes only, and only suffixes that begin near a common q-gram can be equal that far. So
the suffixes are not all sorted: each window of 200 bytes is filed under one q-gram of its own (``anchors``), and the initial
buckets are the anchors' q-grams. A bucket with one anchor is done. Anchors whose whole surroundings are equal are counted
first and stand for each other from then on, so that a passage of which all rows have a copy is one row of its bucket.

Buckets are refined by the buckets of later offsets. While a bucket has more rows than one task takes (``MOST``), its windows
are halved by their distance to the anchor; all windows of a half share a core of bytes, longer than the q-gram, and the core
is the new bucket. Rows alone in a bucket drop out; a bucket whose rows agree on all its windows is done; after eight
halvings a bucket has one window. Inside a task (``refined``), the suffixes at every eighth byte begin in buckets of 8-grams;
buckets of several are split by the pointers of the suffixes further on, and each round reads the pointers that the round
before has set, until every suffix has a bucket of its own or its equals. Neighbours in the two orders (bytes after the anchor,
and before it, read backwards) and their common lengths then tell for each window whether it has an equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import LENGTH, REACH, anchors, last_windows
from .common import bounded_batches, settle

#: Rows of a bucket in one task, and of all buckets of a task, about.
MOST, UNIT = 2_000, 20_000
SIDE = REACH + LENGTH  # bytes kept around an anchor


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text: its size and digest, and of each anchor the q-gram's hash and that of all that its windows cover."""
    names = ["row_id", "doc_id", "text_key", "n_bytes", "sha", "keys", "wholes"]
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            out = []
            for x in part.column(3):
                data = _bytes(x.as_py())
                key, place, first = anchors(data)
                end = last_windows(len(data), first) + LENGTH
                whole = [int.from_bytes(hashlib.blake2b(data[s:e] + b"%d" % (a - s), digest_size=8).digest(), "little", signed=True) for s, e, a in zip(first.tolist(), end.tolist(), place.tolist(), strict=True)]
                out.append((len(data), hashlib.sha256(data).digest(), key.view(np.int64), whole))
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.record_batch([*part.columns[:3], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each anchor asked for: key, row_id, place, its least and most distance to a window's start, bytes around it."""
    for batch in batches:
        for r in range(batch.num_rows):
            data = _bytes(batch.column(1)[r].as_py())
            row = batch.column(0)[r].as_py()
            asked = batch.column(2)[r].as_py()
            _, place, first = anchors(data)
            last = last_windows(len(data), first)
            out = []
            padded = b"\0" * REACH + data + b"\0" * LENGTH
            for x in asked:
                a = int(place[x["k"]])
                out.append((x["key"], row, a, a - int(last[x["k"]]), a - int(first[x["k"]]), x["single"], x["large"], padded[a : a + SIDE]))
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "row_id", "place", "lo", "hi", "single", "large", "around"])


SURROUNDINGS = "key long, row_id long, place long, lo int, hi int, single boolean, large boolean, around binary"


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].reshape(x.shape).astype(np.int64)


def refined(bucket: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by (bucket, bytes), and each row's common length with the one before it in its bucket, or -1.

    ``pointer`` has the bucket of each suffix that begins at a multiple of 8 bytes: the place of the bucket's first suffix in
    the order of all. A round splits the buckets of several by the pointers ``ahead`` suffixes further on and writes the new
    pointers back, so that the next round's ones tell twice as many bytes. Suffixes alone in their bucket aren't touched again.
    """
    n, width = side.shape
    q = -(-width // 8)
    full = np.zeros((n, q * 8), np.uint8)
    full[:, :width] = side
    grams = full.view(">u8").astype(np.uint64).reshape(-1)
    order = np.argsort(grams, kind="stable")
    pointer = np.empty(n * q, np.int64)
    pointer[order] = _starts(grams[order])
    offset = np.tile(np.arange(q), n)
    ahead = 1
    while ahead < q:
        at = np.flatnonzero(np.bincount(pointer, minlength=n * q)[pointer] > 1)
        if not len(at):
            break
        within = offset[at] + ahead < q  # a suffix that ends before comes first
        later, own = np.where(within, pointer[np.where(within, at + ahead, 0)], -1), pointer[at]
        by = np.lexsort((later, own))
        own, later, at = own[by], later[by], at[by]
        new = np.concatenate([[True], own[1:] != own[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        moved = np.maximum.accumulate(np.where(np.concatenate([[True], later[1:] != later[:-1]]) | new, np.arange(len(at)), 0))
        pointer[at] = own + (moved - first)
        ahead *= 2
    order = np.lexsort((pointer.reshape(n, q)[:, 0], bucket))
    a = side[order]
    differ = a[1:] != a[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.concatenate([[-1], np.where(bucket[order][1:] == bucket[order][:-1], common, -1)])
    return order, common


def _starts(x: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the first place of an equal value."""
    return np.maximum.accumulate(np.where(np.concatenate([[True], x[1:] != x[:-1]]), np.arange(len(x)), 0))


def repeated_windows(bucket: np.ndarray, around: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(rows, REACH + 1): whether the row's window that begins so many bytes before its anchor has an equal in another row."""
    n = len(bucket)
    back_order, back = refined(bucket, np.ascontiguousarray(around[:, REACH - 1 :: -1]))
    on_order, on = refined(bucket, np.ascontiguousarray(around[:, REACH:]))
    out = np.zeros((n, REACH + 1), bool)
    before, after = np.empty(n, np.int64), np.empty(n, np.int64)
    for off in range(int(lo.min()), int(hi.max()) + 1):
        rows = np.flatnonzero((lo <= off) & (off <= hi))
        if len(rows) < 2:
            continue
        before[back_order] = np.cumsum(back < off)
        after[on_order] = np.cumsum(on < LENGTH - off)
        _, inverse, count = np.unique(before[rows] * (n + 1) + after[rows], return_inverse=True, return_counts=True)
        out[rows, off] = count[inverse] > 1
    return out


def _refine(batch: pa.Table) -> pa.Table:
    batch = batch.combine_chunks()
    key, row, place, lo, hi = (batch.column(c).to_numpy() for c in ("key", "row_id", "place", "lo", "hi"))
    single = batch.column("single").to_numpy(zero_copy_only=False)
    around = np.frombuffer(b"".join(batch.column("around").to_pylist()), np.uint8).reshape(-1, SIDE)
    found = repeated_windows(_dense(key), around, lo, hi)[single]
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    r, first = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    at = place[single][r]
    return pa.table({"row_id": pa.array(row[single][r], pa.int64()), "s": pa.array(at - stop + 1, pa.int64()), "e": pa.array(at - first + LENGTH, pa.int64())})


def halved(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Buckets of more than ``MOST`` rows refined until they fit or are done: rows that fit, spans told, and the number of the first.

    The rows' windows with distances x to y to their anchor share the bytes of the least and the last of them; where all rows of
    a bucket agree on all that these windows cover, each window has an equal. No step gathers a bucket: rows are counted by
    bucket and joined with the count.
    """
    rows = rows.select("*", F.lit(0).alias("x"), F.lit(REACH).alias("y")).withColumn("key", F.col("key").cast("string"))
    fit, told, total = [], [], 0
    while True:
        mid = F.floor((F.col("x") + F.col("y")) / 2).cast("int")
        halves = F.inline(F.array(F.struct(F.col("x").alias("p"), mid.alias("q")), F.struct((mid + 1).alias("p"), F.col("y").alias("q"))))
        cut = rows.select("*", halves).withColumns({"x": F.col("p"), "y": F.col("q")}).drop("p", "q").filter("lo <= y and hi >= x")
        core = F.substr("around", F.lit(REACH + 1) - F.col("x"), F.lit(LENGTH) - F.col("y") + F.col("x"))
        every = F.substr("around", F.lit(REACH + 1) - F.col("y"), F.lit(LENGTH) + F.col("y") - F.col("x"))
        cut = cut.withColumns({"key": F.md5(F.concat(F.concat_ws(":", "key", "x", "y").cast("binary"), core)), "_every": F.md5(every)})
        count = cut.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("single").alias("singles"), ((F.min("_every") == F.max("_every")) | (F.min("x") == F.max("y"))).alias("told"))
        count = settle(count.filter("n > 1 and singles > 0").withColumn("fits", F.col("n") <= MOST), "large-bucket-counts")
        size = count.agg(F.coalesce(F.sum(F.when(F.expr("fits and not told"), F.col("n"))), F.lit(0)), F.count_if(F.expr("not fits and not told"))).first()
        live = cut.join(count.select("key", "told", "fits"), "key").withColumns({"lo": F.greatest("lo", "x"), "hi": F.least("hi", "y")})
        live = settle(live, "large-buckets")
        told.append(live.filter("told and single").select("row_id", (F.col("place") - F.col("hi")).alias("s"), (F.col("place") - F.col("lo") + LENGTH).alias("e")))
        fit.append(live.filter("fits and not told").withColumn("key", F.xxhash64("key")).select("key", "row_id", "place", "lo", "hi", "single", "around"))
        total += size[0]
        if not size[1]:
            return reduce(DataFrame.unionByName, fit), reduce(DataFrame.unionByName, told), total
        rows = live.filter("not fits and not told").drop("told", "fits", "_every")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its repeated windows."""
    for batch in batches:
        out = []
        for r in range(batch.num_rows):
            data = _bytes(batch.column(2)[r].as_py())
            step = np.zeros(len(data) + 1, np.int32)
            whole = batch.column(3)[r].as_py() or []
            if whole:
                _, _, first = anchors(data)
                end = last_windows(len(data), first) + LENGTH
                np.add.at(step, first[whole], 1)
                np.add.at(step, end[whole], -1)
            for x in batch.column(4)[r].as_py() or []:
                step[x["s"]] += 1
                step[x["e"]] -= 1
            gone = np.cumsum(step[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
            out.append((int(gone.sum()), spans, hashlib.sha256(kept).digest()))
        cols = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.binary())
        yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "text_key", "n_removed", "n_spans", "kept_sha"])


def repeats_removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``.

    Every byte of a 200-byte string that also starts elsewhere, in any row or the same one, is removed. A null text is empty. A
    text of fewer than 200 bytes stays whole. Repeated rows repeat each other. Null ids are rows like others; other columns of
    ``docs`` are left out.
    """
    keyed = bounded_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    fields = "row_id long, doc_id long, text_key long, n_bytes long, sha binary, keys array<long>, wholes array<long>"
    scan = settle(keyed.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text_key", "text").mapInArrow(_scan, fields), "anchors")

    every = scan.select("row_id", F.posexplode(F.arrays_zip("keys", "wholes")).alias("k", "x")).select("row_id", "k", F.col("x.keys").alias("key"), F.col("x.wholes").alias("whole"))
    # each table of counts is settled before it is joined, so that only the join needs a key's rows together and can split them
    common = settle(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "common-keys")
    held = settle(every.join(common, "key"), "common-anchors")
    kinds = settle(held.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_id", "k")).alias("one")), "kinds")
    of_key = settle(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("singles")), "kinds-of-key")
    told = settle(kinds.join(of_key, "key").filter("n > 1 or kinds > 1"), "told")
    ask = (F.col("kinds") > 1) & (F.col("singles") > 0) & (F.struct("row_id", "k") == F.col("one"))
    flags = held.join(told, ["key", "whole"]).select("row_id", "k", "key", (F.col("n") == 1).alias("single"), ask.alias("ask"), (F.col("kinds") > MOST).alias("large"))
    flags = flags.groupBy("row_id").agg(
        F.collect_list(F.when(~F.col("single"), F.col("k"))).alias("whole"), F.collect_list(F.when(F.col("ask"), F.struct("k", "key", "single", "large"))).alias("asked")
    )
    # equal rows have the same k in whole, but the anchors asked for can lie with any of them
    flags = flags.join(scan.select("row_id", "doc_id", "text_key"), "row_id").groupBy("doc_id", "text_key").agg(
        F.min("row_id").alias("row_id"), F.first("whole").alias("whole"), F.flatten(F.collect_list(F.when(F.size("asked") > 0, F.col("asked")))).alias("asked")
    )
    flags = settle(flags, "anchor-flags")
    sums = flags.select(F.size("asked").alias("n"), F.exists("asked", lambda x: x["large"]).alias("large")).agg(F.sum("n"), F.max("large")).first()

    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key"))
    marked = flags.withColumnsRenamed({"doc_id": "f_id", "text_key": "f_key"})
    around = keyed.join(marked.filter(F.size("asked") > 0), same).select("row_id", "text", "asked").mapInArrow(_surroundings, SURROUNDINGS)
    around = settle(around, "surroundings")
    rows, n = around.filter("not large").drop("large"), sums[0] or 0
    settled = None
    if sums[1]:
        more, settled, extra = halved(around.filter("large").drop("large"))
        rows, n = rows.unionByName(more), n + extra
    units = max(1, -(-n // UNIT))
    spans = rows.withColumn("unit", F.pmod(F.xxhash64("key"), F.lit(units))).groupBy("unit").applyInArrow(_refine, "row_id long, s long, e long")
    if settled is not None:
        spans = spans.unionByName(settled)
    spans = spans.groupBy("row_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    judged = keyed.join(marked.drop("asked").join(spans, "row_id", "left").filter("size(whole) > 0 or spans is not null"), same)
    judged = judged.select("doc_id", "text_key", "text", "whole", "spans").mapInArrow(_cut, "doc_id long, text_key long, n_removed long, n_spans long, kept_sha binary")
    judged = judged.dropDuplicates(["doc_id", "text_key"]).withColumnsRenamed({"doc_id": "f_id", "text_key": "f_key"})
    out = scan.select("doc_id", "text_key", "n_bytes", "sha").join(judged, same, "left")
    nought = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", nought).alias("n_removed"), F.coalesce("n_spans", nought).alias("n_spans"), F.lower(F.hex(F.coalesce("kept_sha", "sha"))).alias("kept_sha256"))
