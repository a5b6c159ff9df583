"""Importance resampling towards a target distribution, by hashed word features.

External sort-count: each group of texts becomes one row with the packed uint16 buckets of all its features and the offset of
each document in them, written to the shared folder. The streams are sorted and run-length encoded for the counts; later the
same streams gather the buckets' gains, summed between the offsets by ``np.add.reduceat``. Texts are read and hashed once.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import groups
from .common import bounded_batches, settle

#: Buckets of features; they must fit in 16 bits.
BUCKETS = 10_000
#: A document must have so many words to be drawn.
LEAST_WORDS = 20
SEED = 7
#: A row of the streams holds texts of about so many characters, or one text.
GROUP_CHARS = 1_000_000
#: The words of lower-cased UTF-8: ASCII digits and letters, and all beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
STREAMS = "ids array<long>, words array<long>, offsets array<long>, stream binary"


def _advance(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The linear map ``by`` (images of the 32 bits) applied to each of ``rows``."""
    out = np.zeros_like(rows)
    for bit in range(32):
        out ^= np.where(rows >> np.uint32(bit) & np.uint32(1), by[bit], np.uint32(0))
    return out


@lru_cache(maxsize=256)
def _zeros(n: int) -> np.ndarray:
    """Images of the 32 bits of a CRC-32 register when ``n`` zero bytes follow."""
    if n == 0:
        return np.uint32(1) << np.arange(32, dtype=np.uint32)
    if n == 1:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(8):
            bits = np.where(bits & np.uint32(1), bits >> np.uint32(1) ^ np.uint32(0xEDB88320), bits >> np.uint32(1))
        return bits
    half = _zeros(n // 2)
    whole = _advance(half, half)
    return _advance(whole, _zeros(1)) if n % 2 else whole


@lru_cache(maxsize=256)
def _tables(n: int) -> np.ndarray:
    """For each of the four bytes of a register, the image of each of its values when ``n`` zero bytes follow."""
    value = np.arange(256, dtype=np.uint32)
    return np.stack([_advance(value << np.uint32(8 * k), _zeros(n)) for k in range(4)])


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of each ``left`` text followed by its ``right`` text, from their own and the right one's length in bytes."""
    out = np.empty_like(left)
    order = np.argsort(length, kind="stable")
    cut = np.flatnonzero(np.diff(length[order])) + 1
    for part in np.split(order, cut) if len(order) else []:
        t, x = _tables(int(length[part[0]])), left[part]
        out[part] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24] ^ right[part]
    return out


def feature_buckets(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed buckets of all features (each word, then each pair of neighbours, document by document), where each document
    begins in them (and the end), and the words of each document."""
    known: dict[bytes, int] = {}
    number = known.setdefault
    ids, counts = [], []
    for t in texts:
        found = WORD.findall(t.encode("utf-8", "surrogatepass").lower())
        ids.append(np.fromiter((number(w, len(known)) for w in found), np.int64, len(found)))
        counts.append(len(found))
    n = np.array(counts, np.int64)
    flat = np.concatenate([*ids, np.zeros(0, np.int64)])
    crc = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))
    length = np.fromiter(map(len, known), np.int64, len(known))
    spaced = joined_crc(crc, np.full(len(crc), zlib.crc32(b" "), np.uint32), np.ones(len(crc), np.int64))
    doc = np.repeat(np.arange(len(texts)), n)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    both = joined_crc(spaced[flat[pair]], crc[flat[pair + 1]], length[flat[pair + 1]])
    per = n + np.maximum(n - 1, 0)
    start = np.concatenate([[0], np.cumsum(per)])
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    out = np.empty(int(start[-1]), np.uint16)
    place = np.arange(len(flat)) - first[doc]
    out[start[doc] + place] = crc[flat] % np.uint32(buckets)
    out[start[doc[pair]] + n[doc[pair]] + place[pair]] = both % np.uint32(buckets)
    return out, start, n


def _streams(buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in groups(batch.column(1).to_pylist(), GROUP_CHARS):
                stream, start, words = feature_buckets(texts, buckets)
                ids = batch.column(0).slice(at, len(texts)).to_pylist()
                yield pa.record_batch(
                    [pa.array([ids], pa.list_(pa.int64())), pa.array([words], pa.list_(pa.int64())), pa.array([start], pa.list_(pa.int64())), pa.array([stream.tobytes()], pa.binary())],
                    names=["ids", "words", "offsets", "stream"],
                )
                at += len(texts)

    return work


def bucket_streams(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row a group of the texts of ``texts`` (id, text): ids, words, offsets (one more than ids) and the packed stream."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit in 16 bits")
    return bounded_batches(texts).mapInArrow(_streams(buckets), STREAMS)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column(0):
            order = np.sort(np.frombuffer(packed.as_buffer(), np.uint16))
            if len(order):
                run = np.concatenate([[0], np.flatnonzero(np.diff(order)) + 1, [len(order)]])
                yield pa.record_batch([pa.array(order[run[:-1]].astype(np.int64)), pa.array(np.diff(run))], names=["bucket", "n"])


def bucket_counts(streams: DataFrame) -> DataFrame:
    """(bucket, n) over all rows of ``streams``: each is sorted and run-length encoded, then the runs are summed."""
    return streams.select("stream").mapInArrow(_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """What each bucket says for the target, in thousandths of a nat: smoothed log ratio of the shares, rounded down.

    Only the counts of the buckets, at most ``buckets`` rows of either, come to the driver.
    """
    both = []
    for counts in (raw, target):
        n = [0] * buckets
        for row in counts.collect():
            n[row["bucket"]] = row["n"]
        both.append(n)
    s_all, t_all = (sum(n) + buckets for n in both)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(*both, strict=True)], np.int64)


def drawn_noise(doc_id: int | None, seed: int) -> int:
    """A draw from Gumbel's distribution in thousandths, by the id alone; a null id is written as nothing."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _gathered(gains: np.ndarray, seed: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, words, start = (batch.column(c)[k].values for c in range(3))
                stream = np.frombuffer(batch.column(3)[k].as_buffer(), np.uint16)
                start = start.to_numpy()
                n = np.diff(start)
                filled = np.flatnonzero(n)
                weight = np.zeros(len(n), np.int64)
                if len(filled):
                    weight[filled] = np.add.reduceat(gains[stream], start[filled]) // n[filled]
                noise = np.fromiter((drawn_noise(i, seed) for i in ids.to_pylist()), np.int64, len(n))
                yield pa.record_batch([ids, pa.array(n), words, pa.array(weight), pa.array(weight + noise)], names=["doc_id", "n_features", "n_words", "weight", "score"])

    return work


def ranked(scored: DataFrame, chosen: Column, percent: int) -> DataFrame:
    """``scored`` with rank: 1, 2, 3 ... for the highest scores of the floor(percent * N / 100) drawn of the N ``chosen`` rows,
    ties to the smaller doc_id (nulls last); null for all others.

    Scores are whole thousandths of nats, so there are at most some hundred thousand different ones however many rows there are:
    their counts are the one small table whose running sum needs an order over all. Places within a score are a window each.
    """
    fit = scored.withColumn("_fit", F.coalesce(chosen, F.lit(False)))
    by_score = settle(fit.filter("_fit").groupBy("score").agg(F.count(F.lit(1)).alias("n")), "score-counts")
    draw = (by_score.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * percent) // 100
    before = by_score.select("score", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("_before")).filter(F.col("_before") < draw)
    placed = fit.filter("_fit").join(before, "score").withColumn("_place", F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"))))
    drawn = placed.withColumn("rank", (F.col("_before") + F.col("_place")).cast("long")).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = fit.join(before, "score", "left_anti").unionByName(fit.filter("not _fit").join(before, "score", "left_semi")).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*scored.columns, "rank").unionByName(rest.select(*scored.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight, score, rank for each row of ``docs``, drawn towards the texts of ``target``.

    Words are runs of ASCII digits and letters (A-Z lower-cased) and of everything beyond ASCII; features are words and pairs of
    neighbours, repeats counted. A null text has none: weight 0. Rows of equal doc_id and text have equal scores and different
    ranks. An empty table gives an empty one; an empty target leaves all gains to smoothing. Other columns are left out.
    """
    streams = settle(bucket_streams(docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")), buckets), "bucket-streams")
    wanted = bucket_streams(target.select(F.lit(None).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")), buckets)
    gains = bucket_gains(bucket_counts(streams), bucket_counts(wanted), buckets)
    scored = settle(streams.mapInArrow(_gathered(gains, seed), "doc_id long, n_features long, n_words long, weight long, score long"), "scored")
    return ranked(scored, F.col("n_words") >= least_words, percent)
