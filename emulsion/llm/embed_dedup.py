"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks.

Equal vectors are one class. A class's unit vector is hashed in several tables, each by the quantised values of a few random
projections; classes that share a bucket may be linked, and only then are compared. A sketch of signs (of more projections) rides
along with each table row, so vectors themselves move only for pairs that the sketch lets through.

Copies of one vector with noise would still be pairs by the square of their number. So first they become cells: all classes
within half the linking angle of a head are linked with each other by the triangle inequality, and are counted, not compared.
What is compared are classes of different cells in a bucket. A bucket that is too large for one piece of work has its largest
cell in blocks, and what else it holds meets each block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, settle
from .graph import components
from .shingles import mixed

#: Width of a bucket of one projection, in lengths of the unit vector.
WIDTH = 2.5
#: Chance that a pair just at the threshold shares no table.
MISS = 1e-3
#: Random vectors that a bucket may hold besides those alike; sets how many projections key a table.
MATES = 32
#: Standard deviations that the sketch of a pair just at the limit may lie off: one in three million does.
SLACK = 5
SIGNS = 128
#: Classes of a block, and about so many rows of one piece of work.
BLOCK, UNIT_ROWS = 1000, 20_000
EDGE = 1e-9


def shared_chance(distance: float) -> float:
    """Chance that one quantised projection puts two points so far apart in the same bucket."""
    x = WIDTH / distance
    tail = 0.5 * math.erfc(x / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def design(n: int, cosine: float) -> tuple[int, int]:
    """Projections of a table and number of tables for ``n`` vectors: unlike vectors (at right angles) share a bucket with MATES
    others at most on average, and a pair just at ``cosine`` is missed with chance MISS, at every size."""
    far, near = shared_chance(math.sqrt(2)), shared_chance(math.sqrt(2 - 2 * cosine))
    k = max(4, math.ceil(math.log(max(n, 1) / MATES) / -math.log(far))) if n > MATES else 4
    return k, math.ceil(math.log(MISS) / math.log(1 - near**k))


def most_signs(angle: float) -> int:
    """Signs in which the sketches of two vectors at ``angle`` may differ."""
    p = angle / math.pi
    return math.floor(SIGNS * p + SLACK * math.sqrt(SIGNS * p * (1 - p)))


def units(rows: list) -> tuple[list[np.ndarray], np.ndarray]:
    """Unit vectors in double precision of the rows that have one, and which rows these are."""
    out, at = [], []
    for i, row in enumerate(rows):
        if row is None or not len(row):
            continue
        x = np.asarray(row, np.float64)
        top = np.abs(x).max()
        if np.isfinite(top) and top > 0:
            x = x / top
            out.append(x / math.sqrt(float(x @ x)))
            at.append(i)
    return out, np.array(at, np.int64)


def _lists(column: pa.Array) -> list:
    """The rows of a list column as arrays of doubles (a null component is not a number); null rows are None."""
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    offset = column.offsets.to_numpy()
    return [flat[a:b] if ok else None for a, b, ok in zip(offset[:-1], offset[1:], column.is_valid().to_pylist(), strict=True)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without a direction get no digest; 0.0 and -0.0 are alike."""
    for batch in batches:
        rows = _lists(batch.column(1))
        _, at = units(rows)
        digest: list[bytes | None] = [None] * len(rows)
        for i in at.tolist():
            digest[i] = hashlib.blake2b((rows[i] + 0.0).tobytes(), digest_size=16).digest()
        yield pa.record_batch([batch.column(0), pa.array(digest, pa.binary()), batch.column(1)], names=["vec_id", "digest", "embedding"])


@lru_cache(maxsize=4)
def _projections(dim: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, n)), rng.uniform(0, WIDTH, n)


def _hashed(k: int, tables: int, seed: int):
    """Rows (id, keys, s1, s2). Vectors of different dimensions get different keys, since they are never compared."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _lists(batch.column(1))
            dims = np.array([len(r) for r in rows])
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                lines, offset = _projections(dim, k * tables, seed)
                signs, _ = _projections(dim, SIGNS, seed + 1)
                unit = np.stack(units([rows[i] for i in at.tolist()])[0])
                cell = np.floor((unit @ lines + offset) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(at), tables, k)
                key = np.broadcast_to(mixed(np.arange(tables, dtype=np.uint64) + np.uint64(dim << 20)), (len(at), tables))
                for j in range(k):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, j])
                bits = np.packbits(unit @ signs > 0, axis=1).view(np.int64)
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(at)), pa.array(list(key.view(np.int64)), pa.list_(pa.int64())), pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy())], names=["id", "keys", "s1", "s2"]
                )

    return work


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, head, cosine) of rows (id, head, embedding, head_embedding)."""
    for batch in batches:
        a, b = units(_lists(batch.column(2)))[0], units(_lists(batch.column(3)))[0]
        cosine = np.array([float(x @ y) if len(x) == len(y) else -1.0 for x, y in zip(a, b, strict=True)])
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cosine, pa.float64())], names=["id", "head", "cosine"])


def cells(held: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """(id, cell): classes that lie within half the linking angle of the head of one of their buckets, by that head.

    A bucket's head is its class of least hash. A class is compared with the least of the heads whose sketch may be near enough,
    so that the copies of one vector nearly all choose the same.
    """
    half = math.acos(cosine) / 2
    head = F.min(F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("head"), F.col("s1").alias("h1"), F.col("s2").alias("h2"))).alias("x")
    heads = settle(held.groupBy("key").agg(head).select("key", "x.*"), "heads")
    apart = F.bit_count(F.col("s1").bitwiseXOR(F.col("h1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("h2")))
    near = held.join(heads, "key").filter((apart <= most_signs(half)))
    asked = settle(near.groupBy("id").agg(F.min(F.struct("h", "head")).alias("x")).select("id", F.col("x.head").alias("head")), "asked")
    pieces = asked.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    pieces = settle(pieces, "head-pieces")
    dealt = asked.join(pieces, "head").select("id", "head", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("salt"))
    whose = pieces.select(F.col("head").alias("id"), "head", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"))
    points = classes.select("id", "embedding")
    beside = dealt.join(points, "id").join(whose.join(points.withColumnRenamed("embedding", "other"), "id").drop("id"), ["head", "salt"])
    cosines = bounded_batches(beside.select("id", "head", "embedding", "other")).mapInArrow(_beside, "id long, head long, cosine double")
    out = settle(cosines.filter(F.col("cosine") >= math.cos(half) + EDGE).select("id", F.col("head").alias("cell")), "cells")
    discard(heads, asked, pieces)
    return out


def pieces_of(held: DataFrame) -> DataFrame:
    """``held`` (key, id, cell, ...) dealt to pieces of work: more columns i, j, own (the block of the row), of keys that more than
    one cell shares.

    A key's largest cell makes blocks of its own, which are not compared with each other; all else makes other blocks, which
    are compared with themselves, each other and those of the cell. A key of up to BLOCK rows is one piece.
    """
    counted = held.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.groupBy("key").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows"), F.max(F.struct("n", "cell")).alias("top")).filter("cells > 1")
    whole = F.col("rows") <= BLOCK
    sizes = settle(
        sizes.select(
            "key", F.when(whole, None).otherwise(F.col("top.cell")).alias("core"), F.when(whole, 0).otherwise(F.ceil(F.col("top.n") / BLOCK)).cast("int").alias("core_blocks"),
            F.when(whole, 1).otherwise(F.ceil((F.col("rows") - F.col("top.n")) / BLOCK)).cast("int").alias("blocks"),
        ), "key-sizes",
    )
    rows = held.join(sizes, "key").withColumn("is_core", F.coalesce(F.col("cell") == F.col("core"), F.lit(False)))
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    own = F.when(F.col("is_core"), F.col("blocks") + deal(F.greatest("core_blocks", F.lit(1)))).otherwise(deal(F.col("blocks")))
    last = F.when(F.col("is_core"), F.col("blocks") - 1).otherwise(F.col("blocks") + F.col("core_blocks") - 1)
    meets = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return meets.select(*held.columns, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _pieces(batch: pa.Table, *columns: str):
    """The ``columns`` of a unit of work in pieces (key, i, j), as arrays, with what may be compared: see ``may_meet``."""
    batch = batch.combine_chunks().sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("id", "ascending")])
    where = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
    cut = np.concatenate([[0], np.flatnonzero((np.diff(where) != 0).any(axis=0)) + 1, [batch.num_rows]])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a > 1:
            yield a, b


def may_meet(own: np.ndarray, cell: np.ndarray, i: int, j: int, rows: slice) -> np.ndarray:
    """Which of ``rows`` and of all rows of a piece are to be compared: those of different cells, in the blocks i and j."""
    across = cell[rows, None] != cell[None, :]
    return across & (own[rows, None] != own[None, :]) if i != j else across


def _plausible(most: int):
    """(key, id, own, i, j) of rows whose sketch is near enough to that of a row they may meet."""

    def work(batch: pa.Table) -> pa.Table:
        names = ("key", "id", "cell", "own", "i", "j", "s1", "s2")
        batch = batch.combine_chunks().sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("id", "ascending")])
        key, ids, cell, own, i, j, s1, s2 = (batch.column(c).to_numpy() for c in names)
        s1, s2 = s1.view(np.uint64), s2.view(np.uint64)  # of a signed number, numpy counts the bits of its size
        keep = np.zeros(len(ids), bool)
        for a, b in _pieces(batch):
            for at in range(a, b, 256):
                part = slice(at - a, min(at + 256, b) - a)
                apart = np.bitwise_count(s1[a:b][part, None] ^ s1[None, a:b]) + np.bitwise_count(s2[a:b][part, None] ^ s2[None, a:b])
                near = (apart <= most) & may_meet(own[a:b], cell[a:b], i[a], j[a], part)
                keep[a:b][part] |= near.any(axis=1)
        at = np.flatnonzero(keep)
        return pa.table({c: pa.array(v[at]) for c, v in zip(("key", "id", "cell", "own", "i", "j"), (key, ids, cell, own, i, j), strict=True)})

    return work


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` points the least one reachable over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _linked(cosine: float):
    """(id, links, near): of each class, the rows it is linked with and whose first shared table is this; near is the least class
    reachable in the piece, so that a piece's links are a spanning forest."""

    def work(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks().sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("id", "ascending")])
        key, ids, cell, own, i, j, n = (batch.column(c).to_numpy() for c in ("key", "id", "cell", "own", "i", "j", "n"))
        vectors = _lists(batch.column("embedding").combine_chunks())
        keys = batch.column("keys").combine_chunks()
        keys = keys.values.to_numpy().reshape(len(ids), -1)
        out: list[list[np.ndarray]] = [[], [], []]
        for a, b in _pieces(batch):
            unit = np.stack(units(vectors[a:b])[0])
            own_keys, left, right = keys[a:b], [], []
            for at in range(a, b, 256):
                part = slice(at - a, min(at + 256, b) - a)
                x, y = np.nonzero((unit[part] @ unit.T >= cosine) & may_meet(own[a:b], cell[a:b], i[a], j[a], part))
                left.append(x + part.start)
                right.append(y)
            x, y = np.concatenate(left), np.concatenate(right)
            x, y = x[x < y], y[x < y]
            links = np.zeros(b - a, np.int64)
            for at in range(0, len(x), 10_000):
                u, v = x[at : at + 10_000], y[at : at + 10_000]
                first = own_keys[u, (own_keys[u] == own_keys[v]).argmax(axis=1)] == key[a]
                np.add.at(links, u[first], n[a:b][v[first]])
                np.add.at(links, v[first], n[a:b][u[first]])
            root = forest(b - a, x, y)
            told = np.flatnonzero((links > 0) | (root != np.arange(b - a)))
            for part, values in zip(out, (ids[a:b][told], links[told], ids[a:b][root[told]]), strict=True):
                part.append(values)
        flat = [np.concatenate([*x, np.zeros(0, np.int64)]) for x in out]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("id", "links", "near"), flat, strict=True)})

    return work


def in_units(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` with unit: pieces are dealt to units of about UNIT_ROWS rows."""
    return rows.withColumn("unit", F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, -(-total // UNIT_ROWS)))))


def vector_links(vectors: DataFrame, cosine: float = 0.9, seed: int = 13) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding).

    Two rows are linked if their cosine in double precision is ``cosine`` (above 0) or more and a table brings them together, which fails with
    chance MISS just at ``cosine`` and far less above. n_links counts other rows, copies and repeated rows each. component_id is the
    least vec_id reachable. A vector that is null, empty, zero or holds a null or non-finite component is linked with nothing,
    nor are vectors of different dimensions with each other. A row with a null vec_id counts like others; a component of such rows alone has a
    null component_id and kept true. An empty table gives an empty one. Other columns are left out.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = bounded_batches(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    signed = settle(rows.mapInArrow(_digests, f"vec_id long, digest binary, embedding {kind}"), "vectors")
    grouped = signed.filter("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    classes = settle(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    k, tables = design(classes.count(), cosine)
    keyed = settle(classes.select("id", "embedding").mapInArrow(_hashed(k, tables, seed), "id long, keys array<long>, s1 long, s2 long"), "keyed")
    exploded = keyed.select("id", "s1", "s2", F.explode("keys").alias("key"))
    shared = settle(exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared-keys")
    held = settle(exploded.join(shared, "key"), "table-rows")
    cell = cells(held, classes, cosine)
    of_cell = cell.join(classes.select("id", "n"), "id").groupBy("cell").agg(F.sum("n").alias("in_cell"))

    placed = held.join(cell, "id", "left").withColumn("cell", F.coalesce("cell", -F.col("id") - 1))
    dealt = settle(pieces_of(placed), "pieces")
    likely = settle(in_units(dealt, dealt.count()).groupBy("unit").applyInArrow(_plausible(most_signs(math.acos(cosine))), T.StructType([f for f in dealt.schema.fields if f.name not in ("s1", "s2")])), "likely")
    whole = likely.join(classes.select("id", "n", "embedding"), "id").join(keyed.select("id", "keys"), "id")
    found = settle(in_units(whole, likely.count()).groupBy("unit").applyInArrow(_linked(cosine), "id long, links long, near long"), "links")
    discard(shared, held, dealt, likely)

    edges = found.filter("id != near").select(F.col("id").alias("a"), F.col("near").alias("b")).unionByName(cell.select(F.col("id").alias("a"), F.col("cell").alias("b")))
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    sized = classes.select("id", "digest", "first_id", "n").join(linked, "id", "left").join(cell, "id", "left").join(of_cell, "cell", "left").join(components(edges), "id", "left")
    sized = settle(sized.select("digest", "first_id", F.coalesce("root", "id").alias("root"), (F.coalesce("in_cell", "n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "sized")
    least = sized.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = sized.join(least, "root").select("digest", "n_links", "component_id")
    out = signed.select("vec_id", "digest").join(named, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
