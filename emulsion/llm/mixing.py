"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source is a stream of its documents in a permuted order, repeated once per pass, cut into blocks of words. Its quota is a
number of blocks. A binary tree over the output shards splits the vector of quotas: the left child draws its share of the
blocks without replacement, the right one has the rest, down to single shards. A leaf's quotas name consecutive, disjoint
blocks of each permuted stream; a document belongs to the block in which it starts. Each shard orders what it has by a hash
(``place``). The stream's last block is cut at the quota.

Sources stay a table: they are ranked by range partitions, targets take a few sums over all of them, and the tree is split
for groups of them on the driver and within each group in a task of its own. The documents are never ordered in one task: a hash deals a source's
documents to about sqrt(rows) cells, sums by cell give each cell's start in the stream, and a window orders one cell. A shard
is written in chunks of about ``CHUNK_WORDS`` words, stretches of its order, so that no task holds a shard.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, settle

#: Sources whose quotas are split in one task. The tree first splits the sums of such groups, one number a group and shard on the driver.
GROUP_SOURCES = 10_000
#: A stream has so many blocks at most; beyond that its blocks are longer than ``block_words`` (the draws need whole numbers below 1e9).
MOST_BLOCKS = 2**27
#: Words of a shard that are ordered in one task.
CHUNK_WORDS = 2_000_000


def allocate(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> dict[str | None, float]:
    """Words by source: shares of all words by weight, none above ``cap`` times its own, the excess reshared by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size, free, left = dict(order), [s for s, _ in order], float(sum(n for _, n in order))
    target: dict[str | None, float] = {}
    while free:
        unit = left / sum(weight[s] for s in free)
        above = [s for s in free if unit * weight[s] > cap * size[s]]
        if not above:
            return target | {s: unit * weight[s] for s in free}
        for s in above:
            target[s] = cap * size[s]
            left -= target[s]
        free = [s for s in free if s not in target]
    return target


def split_tree(blocks: np.ndarray, shards: int, seed: int, totals: np.ndarray | None = None, group: int = 0) -> np.ndarray:
    """Block counts by shard and source; column sums are ``blocks``, row sums are ``totals`` or differ by at most one."""
    out = np.zeros((shards, len(blocks)), dtype=np.int64)
    todo = [(0, shards, blocks.astype(np.int64))]
    while todo:
        first, n, have = todo.pop()
        if n == 1:
            out[first] = have
            continue
        left_n = n // 2
        take = int(have.sum()) * left_n // n if totals is None else int(totals[first : first + left_n].sum())
        rng = np.random.default_rng([seed, first, n, *([group] if group else [])])
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if take else np.zeros_like(have)
        todo += [(first, left_n, left), (first + left_n, n - left_n, have - left)]
    return out


def ranked_sources(sized: DataFrame) -> DataFrame:
    """source, source_size, n, rank of each source of ``sized`` (source, size), ranked from 0 in code-point order, null last.

    Range partitions are ordered each on its own; the driver adds up their rows.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranged = settle(sums.repartitionByRange(F.asc_nulls_last("source")).withColumn("_part", F.spark_partition_id()), "mix-sources")
    offset, at = [], 0
    for r in sorted(ranged.groupBy("_part").count().collect()):
        offset += [F.lit(r["_part"]), F.lit(at)]
        at += r["count"]
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_last("source"))) - 1
    first = F.element_at(F.create_map(*offset), F.col("_part")) if offset else F.lit(0)
    return ranged.withColumn("rank", first.cast("long") + place).drop("_part")


def with_targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """``sources`` with target, as ``allocate`` has it: each round takes out those above their cap and raises the share of the rest."""
    weight = F.element_at(F.lit([float(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = settle(sources.withColumn("_weight", weight), "mix-weights")
    above = lambda unit: F.lit(unit) * F.col("_weight") > cap * F.col("source_size")
    total, free = weighed.agg(F.sum("source_size"), F.sum("_weight")).first()
    unit, before = float(total or 0) / (free or 1), -1
    while True:
        n, held, free = weighed.agg(F.count_if(above(unit)), F.coalesce(F.sum(F.when(above(unit), F.col("source_size"))), F.lit(0)), F.sum(F.when(~above(unit), F.col("_weight")))).first()
        if n == before or not free:
            break
        unit, before = (float(total) - cap * held) / free, n
    return weighed.withColumn("target", F.when(above(unit), cap * F.col("source_size")).otherwise(F.lit(unit) * F.col("_weight"))).drop("_weight")


def _dealt(shards: int, seed: int):
    def work(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks().sort_by("rank")
        totals = batch.column("totals")[0].values.to_numpy()
        tree = split_tree(batch.column("blocks").to_numpy(), shards, seed, totals, batch.column("group")[0].as_py())
        ends = pa.array(list(np.cumsum(tree, axis=0).T), pa.list_(pa.int64()))
        return batch.select(["source", "source_size", "target", "quota"]).append_column("shard_ends", ends)

    return work


def mix_plan(docs: DataFrame, shards: int = 64, block_words: int = 4096, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 20) -> DataFrame:
    """What the mix takes: doc_id, source, text_key, copy, size, source_size, target, pass, taken, shard, place, chunk.

    One row for each document and pass, also where ``taken`` is 0 (pass 0 only; shard, place and chunk are null there). A null
    text has size 0; a null source is a source of its own; repeated rows are documents of their own (``copy`` numbers them).
    ``place`` orders a shard, and ``chunk`` numbers the stretches of that order that are written by one task each.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    one = Window.partitionBy("doc_id", "source", "text_key").orderBy("size")
    raw = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("text_key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    sized = settle(raw, "mix-sizes")
    targets = with_targets(ranked_sources(sized), weights, cap)
    quota = F.least(F.floor(F.col("target") + 0.5), F.floor(cap * F.col("source_size")))
    quotas = targets.withColumn("quota", quota).withColumn("group", F.floor(F.col("rank") / GROUP_SOURCES))
    rows, words = quotas.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("quota"), F.lit(0))).first()
    unit = max(block_words, math.ceil(words / MOST_BLOCKS))
    chunks = max(1, math.ceil(words / shards / CHUNK_WORDS))
    blocked = quotas.withColumn("blocks", F.ceil(F.col("quota") / unit))
    groups = sorted((r["group"], r["blocks"]) for r in blocked.groupBy("group").agg(F.sum("blocks").alias("blocks")).collect())
    totals = split_tree(np.array([n for _, n in groups], dtype=np.int64), shards, seed) if groups else np.zeros((shards, 0), np.int64)
    shares = spark.createDataFrame([(g, [int(x) for x in totals[:, i]]) for i, (g, _) in enumerate(groups)], "group long, totals array<long>")
    dealt = blocked.join(shares, "group").groupBy("group").applyInArrow(_dealt(shards, seed), "source string, source_size long, target double, quota long, shard_ends array<long>")
    sources = settle(dealt, "mix-quotas")

    cells = 1 << max(0, math.ceil(math.log2(max(1, rows)) / 2))
    held = sized.withColumn("copy", F.row_number().over(one))
    held = held.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    passes = F.sequence(F.lit(0), F.when(F.col("source_size") > 0, F.greatest(F.lit(0), F.ceil(F.col("quota") / F.greatest(F.col("source_size"), F.lit(1))) - 1)).otherwise(0).cast("int"))
    each = held.withColumn("pass", F.explode(passes)).withColumn("h", F.xxhash64(F.lit(seed), "pass", "doc_id", "text_key", "copy")).withColumn("cell", F.pmod("h", F.lit(cells)))
    by_cell = each.groupBy("source", "pass", "cell").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("source", "pass").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_cell.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(before), F.lit(0))).drop("cell_size")
    keys = ("source", "pass", "cell")
    starts = starts.select(*(F.col(k).alias(f"at_{k}") for k in keys), "cell_start")
    inside = Window.partitionBy(*keys).orderBy("h", "doc_id", "text_key", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("in_cell", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    match = F.col("source").eqNullSafe(F.col("at_source")) & (F.col("pass") == F.col("at_pass")) & (F.col("cell") == F.col("at_cell"))
    placed = placed.join(starts, match).withColumn("start", F.col("pass") * F.col("source_size") + F.col("cell_start") + F.col("in_cell"))
    taken = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.col("start")))
    shard = F.size(F.filter("shard_ends", lambda e: e <= F.floor(F.col("start") / unit)))
    # places are 31 bits of a hash and then the rest of it: a chunk is an even share of the first part
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "h", "pass"), 1)
    drawn = placed.withColumn("taken", taken).withColumn("place", place)
    chosen = lambda c: F.when(F.col("taken") > 0, c)
    return drawn.select(
        "doc_id", "source", "text_key", "copy", "size", "source_size", "target", "pass", "taken",
        chosen(shard).alias("shard"), chosen(F.col("place")).alias("place"), chosen(F.shiftright(F.shiftright("place", 32) * chunks, 31).cast("int")).alias("chunk"),
    )


def mix_draws(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, draws for each row of ``docs``.

    ``draws`` has a (shard, place, pass, words) for each time that the mix takes the document, by shard and place; ``taken`` is
    the sum of their words. The edge cases are those of ``mix_plan``.
    """
    row = ("doc_id", "source", "text_key", "copy", "size", "source_size", "target")
    draw = F.when(F.col("taken") > 0, F.struct("shard", "place", "pass", F.col("taken").alias("words")))
    out = mix_plan(docs, **how).groupBy(*row).agg(F.sum("taken").alias("taken"), F.array_sort(F.collect_list(draw)).alias("draws"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "draws")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed rows: the columns of ``docs`` once for each draw, with mix_shard, mix_place and mix_pass.

    They lie as they are to be read: each partition holds whole chunks of shards, by shard and place. A document that the quota cuts has only its first words (through the last one taken); n_chars, where there is one, is set
    anew. Documents without words are not drawn. Columns of the new names, and of ``mix_`` and a plan column's name, in ``docs``
    are replaced.
    """
    new = ("mix_shard", "mix_place", "mix_pass")
    docs = docs.drop(*new, *(f"mix_{c}" for c in ("doc_id", "source", "text_key", "copy", "size", "taken", "chunk")))
    plan = mix_plan(docs, **how).filter("taken > 0")
    plan = plan.select(*(F.col(c).alias(f"mix_{c}") for c in ("doc_id", "source", "text_key", "copy", "size", "taken", "shard", "place", "pass", "chunk")))
    one = Window.partitionBy("doc_id", "source", "_key").orderBy("_key")
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_copy", F.row_number().over(one))
    match = F.col("doc_id").eqNullSafe(F.col("mix_doc_id")) & F.col("source").cast("string").eqNullSafe(F.col("mix_source")) & (F.col("_key") == F.col("mix_text_key")) & (F.col("_copy") == F.col("mix_copy"))
    words = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("mix_taken").cast("int")), "")
    out = keyed.join(plan, match).withColumn("text", F.when(F.col("mix_taken") < F.col("mix_size"), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns, *new, "mix_chunk").repartition("mix_shard", "mix_chunk").sortWithinPartitions("mix_shard", "mix_place").drop("mix_chunk")
