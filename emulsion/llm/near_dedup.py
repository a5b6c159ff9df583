"""MinHash near-dedup with tensored banding.

Texts with equal shingle sets are one class. A class has two collections of ``m`` small hashes, each of ``t`` MinHash minima;
every pair of one from either collection keys a table, so m * m tables need only 2 * m * t minima. Links are confirmed on full
sets, in two ways that lead to the same components:

* Rounds. Each table key that holds classes of more than one component has a head; each class is compared with the head of one
  of its keys, and confirmed links alone connect. A set moves once a round, so near copies of one text cost in proportion.
* What is left when rounds confirm few: classes that still share a key with another component form families, and all that a
  family's sets hold is compared there, in blocks of bounded size. No pair of copies is ever a row in either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import groups
from .common import bounded_batches, discard, settle
from .graph import components
from .shingles import min_hashes, mixed, shingle_sets

ROWS_PER_HASH = 3
#: Chance to miss a pair just at the threshold.
MISS = 2e-3
#: A block holds at most about so many classes and shingles of a family; a piece of work two blocks.
BLOCK_CLASSES, BLOCK_SHINGLES = 400, 400_000
#: Classes and shingles of those that are compared with one head in one piece of work.
HEAD_CLASSES, HEAD_SHINGLES = 64, 200_000
COLUMNS = 1024
#: Texts are hashed in groups of about so many characters, or one text.
GROUP_CHARS = 200_000


def tables_for(percent: int) -> int:
    """Small hashes in a collection, so that a pair just similar enough is missed with chance ``MISS`` at most."""
    s = (percent / 100) ** ROWS_PER_HASH
    m = 2
    while 2 * (1 - s) ** m > MISS:
        m += 1
    return m


def _signatures(k: int, m: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in groups(batch.column(2).to_pylist(), GROUP_CHARS):
                sets = shingle_sets([t.encode("utf-8", "surrogatepass") for t in texts], k)
                filled = [s for s in sets if len(s)]
                small = np.zeros((0, 2 * m), np.int64)
                if filled:
                    mins = min_hashes(filled, 2 * m * ROWS_PER_HASH).reshape(len(filled), 2 * m, ROWS_PER_HASH)
                    key = mins[:, :, 0]
                    for j in range(1, ROWS_PER_HASH):
                        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + mins[:, :, j])
                    small = key.view(np.int64)
                rows = iter(small)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                hashes = [next(rows) if len(s) else [] for s in sets]
                yield pa.record_batch(
                    [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(digest, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "digest", "n_shingles", "small"],
                )
                at += len(texts)

    return work


def _sets(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in groups(batch.column(1).to_pylist(), GROUP_CHARS):
                sets = [s.view(np.int64) for s in shingle_sets([t.encode("utf-8", "surrogatepass") for t in texts], k)]
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])
                at += len(texts)

    return work


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the least place of a set that it is linked with, over any number of links."""
    n = len(sets)
    root = np.arange(n)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(root, size)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    alive = np.ones(n, bool)
    while True:  # a linked set shares ``percent`` of its shingles with others that may be linked
        keep = alive[owner]
        owner, token = owner[keep], token[keep]
        often = np.bincount(token, minlength=1)[token] > 1
        shared = np.bincount(owner[often], minlength=n)
        now = alive & (100 * shared >= percent * size)
        if (now == alive).all():
            break
        alive = now
    left = np.flatnonzero(alive)
    if len(left) < 2:
        return root
    place = np.full(n, -1)
    place[left] = np.arange(len(left))
    often = np.bincount(token)[token] > 1
    row = place[owner[often]]
    _, col = np.unique(token[often], return_inverse=True)
    common = np.zeros((len(left), len(left)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for c in range(0, int(col[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(col, [c, c + COLUMNS])
        part = np.zeros((len(left), COLUMNS), np.float32)
        part[row[a:b], col[a:b] - c] = 1
        common += part @ part.T
    # 100 i >= percent * (a + b - i); single precision holds these whole numbers exactly up to 2**24
    kind = np.float32 if 400 * int(size.max()) < 2**24 else np.float64
    lengths = size[left].astype(kind)
    link = common.astype(kind, copy=False) * (100 + percent) >= percent * (lengths[:, None] + lengths[None, :])
    np.fill_diagonal(link, True)
    label = np.arange(len(left), dtype=np.int32)
    while True:
        near = np.where(link, label[None, :], np.int32(len(left))).min(axis=1)
        near = np.minimum(near, near[near])
        if (near == label).all():
            break
        label = near
    root[left] = left[label]
    return root


def _links(percent: int):
    def work(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks().sort_by([("family", "ascending"), ("i", "ascending"), ("j", "ascending"), ("id", "ascending")])
        key = np.stack([batch.column(c).to_numpy() for c in ("family", "i", "j")])
        ids = batch.column("id").to_numpy()
        lists = batch.column("shingles").combine_chunks()
        offset, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        cut = np.concatenate([[0], np.flatnonzero((np.diff(key) != 0).any(axis=0)) + 1, [len(ids)]])
        out_a, out_b = [], []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            rows = [r for r in range(a, b) if r == a or ids[r] != ids[r - 1]]  # a repeated row of the same text
            if len(rows) < 2:
                continue
            own = ids[rows]
            root = linked([values[offset[r] : offset[r + 1]] for r in rows], percent)
            moved = np.flatnonzero(root != np.arange(len(rows)))
            out_a.append(own[moved])
            out_b.append(own[root[moved]])
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b)]
        return pa.table({"a": pa.array(flat[0], pa.int64()), "b": pa.array(flat[1], pa.int64())})

    return work


def _checked(percent: int):
    def work(batch: pa.Table) -> pa.Table:
        """Links of the sets with their heads; a group (head, salt) has the head's set and some of those compared with it."""
        batch = batch.combine_chunks().sort_by([("head", "ascending"), ("salt", "ascending")])
        head, salt, ids = (batch.column(c).to_numpy() for c in ("head", "salt", "id"))
        lists = batch.column("shingles").combine_chunks()
        offset, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        cut = np.concatenate([[0], np.flatnonzero((np.diff(head) != 0) | (np.diff(salt) != 0)) + 1, [len(ids)]])
        out_a, out_b = [], []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = np.flatnonzero(ids[a:b] == head[a])
            if not len(own) or b - a < 2:
                continue
            base = values[offset[a + own[0]] : offset[a + own[0] + 1]]
            flat = values[offset[a] : offset[b]]
            at = np.minimum(np.searchsorted(base, flat), len(base) - 1)
            total = np.concatenate([[0], np.cumsum(base[at] == flat)])
            both = total[offset[a + 1 : b + 1] - offset[a]] - total[offset[a:b] - offset[a]]
            size = np.diff(offset[a : b + 1])
            link = (100 * both >= percent * (size + len(base) - both)) & (ids[a:b] != head[a])
            out_a.append(ids[a:b][link])
            out_b.append(np.full(int(link.sum()), head[a]))
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b)]
        return pa.table({"a": pa.array(flat[0], pa.int64()), "b": pa.array(flat[1], pa.int64())})

    return work


def _pieces(grouped: str, members: DataFrame, classes: int, shingles: int) -> DataFrame:
    """How many pieces of bounded size the rows (id, n) of each group make."""
    size = F.greatest(F.count(F.lit(1)) / classes, F.sum("n") / shingles)
    return settle(members.groupBy(grouped).agg(F.ceil(size).cast("int").alias("blocks")), "piece-counts")


def with_heads(asked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) of ``asked`` (id, head, n): each set is compared with its head's."""
    pieces = _pieces("head", asked, HEAD_CLASSES, HEAD_SHINGLES)
    members = asked.join(pieces, "head").select("id", "head", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("salt"))
    heads = pieces.select(F.col("head").alias("id"), "head", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"))
    units = max(1, pieces.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0])
    dealt = sets.join(members.unionByName(heads), "id").withColumn("unit", F.pmod(F.xxhash64("head", "salt"), F.lit(units)))
    return dealt.groupBy("unit").applyInArrow(_checked(percent), "a long, b long")


def in_families(near: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the classes that ``near`` (a, b) connects: a spanning forest of each pair of a family's blocks."""
    families = components(near).withColumnRenamed("root", "family")
    members = settle(classes.select("id", "n").join(families, "id"), "family-members")
    members = members.join(_pieces("family", members, BLOCK_CLASSES, BLOCK_SHINGLES), "family")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (F.col("blocks") == 1) | (j != F.col("own"))))
    dealt = sets.join(members, "id").withColumn("own", own).withColumn("other", other).select("family", "id", "shingles", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    units = max(1, -(-members.count() // BLOCK_CLASSES) * 4)
    dealt = dealt.withColumn("unit", F.pmod(F.xxhash64("family", "i", "j"), F.lit(units)))
    return dealt.groupBy("unit").applyInArrow(_links(percent), "a long, b long")


def confirmed_roots(held: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, root) of the classes in confirmed links; ``held`` (key, id) has the classes of each table key that several share."""
    links, roots, turn, few = [], None, 0, False
    while True:
        if roots is None:
            now = held.withColumn("part", F.col("id"))
        else:
            now = settle(held.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("part")), "table-parts")
        head = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "part")).alias("head")
        heads = now.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), head).filter("lo < hi")
        heads = settle(heads.select("key", F.col("head.id").alias("head"), F.col("head.part").alias("head_part")), "table-heads")
        if heads.isEmpty():
            break
        open_ = now.join(heads, "key")
        done = [heads] + [now] * (roots is not None)
        if few:
            links.append(settle(in_families(open_.filter("id != head").select(F.col("id").alias("a"), F.col("head").alias("b")), classes, sets, percent), "links"))
        else:
            one = open_.filter("part != head_part").groupBy("id").agg(F.min(F.struct(F.xxhash64("head", F.lit(turn)).alias("h"), "head")).alias("x"))
            asked = settle(one.select("id", F.col("x.head").alias("head")).join(classes.select("id", "n"), "id"), "asked")
            links.append(settle(with_heads(asked, sets, percent), "links"))
        roots = settle(components(reduce(DataFrame.unionByName, links)), "roots")
        if few:
            break
        few = 2 * links[-1].count() < asked.count()
        discard(*done, asked)
        turn += 1
    return classes.select("id", F.col("id").alias("root")).limit(0) if roots is None else roots


def near_classes(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept for each row of ``docs``.

    Documents with 100 * intersection >= percent * union of their sets of ``k``-word shingles are linked; component_id is the
    least doc_id reachable. A document without words has an empty set and is linked with nothing. A null text is empty. A row
    with a null doc_id belongs to its component; where a component has only null ids, component_id is null and kept is true.
    Repeated rows stay. Other columns of ``docs`` are left out.
    """
    m = tables_for(percent)
    keyed = bounded_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    signed = settle(keyed.mapInArrow(_signatures(k, m), "doc_id long, text_key long, digest binary, n_shingles long, small array<long>"), "signatures")
    one = signed.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("n_shingles").alias("n"), F.first("small").alias("small"))
    classes = settle(one.withColumn("id", F.monotonically_increasing_id()), "classes")

    keys = F.transform(F.sequence(F.lit(0), F.lit(m * m - 1)), lambda i: F.xxhash64(i, F.get("small", F.floor(i / m).cast("int")), F.get("small", m + i % m)))
    tables = classes.select("id", F.explode(keys).alias("key"))
    shared = settle(tables.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared-keys")
    held = settle(tables.join(shared, "key"), "table-keys")
    wanted = classes.join(held.select("id").distinct(), "id").select("id", F.col("row.doc_id").alias("w_id"), F.col("row.text_key").alias("w_key"))
    # always merged: a text's way must not depend on how few are wanted
    texts = keyed.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key"))).select("id", "text")
    # repeated rows of the same text give the same set
    sets = settle(texts.mapInArrow(_sets(k), "id long, shingles array<long>"), "shingle-sets")
    roots = confirmed_roots(held, classes, sets, percent)
    discard(shared, held, sets)
    rooted = classes.select("digest", "id", "first_id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("digest", "component_id")
    out = signed.select("doc_id", "text_key", "digest", "n_shingles").join(named, "digest", "left").withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "text_key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group; of rows alike in doc_id and text, one."""
    stay = near_classes(docs, k, percent).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    keyed = docs.withColumn("_own", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_own"]).select(*docs.columns)
