"""Spelling variants by full neighbourhood generation.

Every distinct deletion, replacement and insertion of a word over the observed alphabet is looked up by its hash among the words;
what is found is near, and needs no check of its distance. Neighbourhoods have some hundreds of strings a word, so these are
made where the words are that they can hit: words that are alike but for one or two places in a row share a key, and only
words are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lower_az, settle
from .shingles import mixed, powers

#: A run of letters: ASCII and those of Latin-1.
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One in so many runs loses a letter.
ODDS = 97
#: An edit is looked for between so many places at a time.
REGION = 2
#: Rows (one a word and place, about) of one piece of work, and of those whose neighbours are made at once.
UNIT_ROWS, CHUNK = 100_000, 2000
#: Neighbours of words up to this length are made; longer words meet by hashes of what is left without one place.
WRITTEN = 64


def noisy(doc_id: Column, run: Column) -> Column:
    """The lower-cased run; where ODDS divides h = crc32 of ``<doc_id>:<run>``, without its code point h modulo its length.

    A null id is written as nothing.
    """
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(h % ODDS == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): what the runs of all texts become, at least ``least_length`` code points long and ``least_count`` times there."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lower_az(F.coalesce("text", F.lit(""))), F.lit(RUN), 0)).alias("run"))
    words = runs.select(noisy(F.col("doc_id"), F.col("run")).alias("word")).filter(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def alphabet(words: DataFrame) -> list[str]:
    """The letters that occur; RUN allows 90 after lower-casing, so that many come to the driver at most."""
    found = words.select(F.array_distinct(F.split("word", "")).alias("c")).select(F.explode("c").alias("c")).filter("c != ''").distinct()
    return sorted(r["c"] for r in found.collect())


def meeting_places(words: DataFrame) -> DataFrame:
    """Rows (key, word, n, at, whole) of ``words`` (word, n): where each word meets those that differ from it between two places.

    Let m be the length of the shorter of two near words. An edit at a place of [at, at + 2) leaves what stands before and after it
    alike, and these, with m and at, are the key. A word is in the keys of m = its length (whole) and of m = its length - 1,
    as the longer of two. So at most the strings over two or three letters share a key, however many words there are.
    """
    own = words.filter(F.char_length("word") <= WRITTEN + 1).select("word", "n", F.char_length("word").alias("size"))
    roles = own.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("whole")).withColumn("m", F.col("size") - F.when(F.col("whole"), 0).otherwise(1))
    placed = roles.filter(f"m between 1 and {WRITTEN}").select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1, F.lit(REGION))).alias("at"))
    end = F.least(F.col("at") + REGION, "m") + F.col("size") - F.col("m")
    return placed.select(F.xxhash64("m", "at", F.substr("word", F.lit(1), "at"), F.substr("word", end + 1)).alias("key"), "word", "n", "at", "whole")


def neighbourhood(code: np.ndarray, at: int, whole: bool, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the strings at one edit of [at, at + REGION) from words of one length (rows of code points), and which are to count.

    Whole words give their replacements and insertions, longer ones of two their deletions. The place after the last letter
    belongs to the last two. Of a run of equal letters only the first is deleted, and a letter is inserted only where none
    like it stands before, so each string comes once.
    """
    rows, size = code.shape
    up, down = powers(size + 2)
    term = mixed(code.astype(np.uint64)) * up[:size]
    total = np.concatenate([np.zeros((rows, 1), np.uint64), np.cumsum(term, axis=1, dtype=np.uint64)], axis=1)
    value = mixed(letters.astype(np.uint64))
    m = size if whole else size - 1
    stop = m + 1 if at + REGION >= m else at + REGION
    for i in range(at, stop):
        before = code[:, i - 1] if i else np.zeros(rows, code.dtype)
        if whole:
            if i < m:
                yield (total[:, -1] - term[:, i])[:, None] + value * up[i], code[:, i, None] != letters
            yield (total[:, i] + (total[:, -1] - total[:, i]) * up[1])[:, None] + value * up[i], before[:, None] != letters
        else:
            yield (total[:, i] + (total[:, -1] - total[:, i + 1]) * down[1])[:, None], (code[:, i] != before)[:, None]


def word_hash(code: np.ndarray) -> np.ndarray:
    up, _ = powers(code.shape[1] + 2)
    return (mixed(code.astype(np.uint64)) * up[: code.shape[1]]).sum(axis=1, dtype=np.uint64)


def _met(letters: list[str]):
    alphabet_codes = np.array([ord(c) for c in letters], np.uint32)

    def work(batch: pa.Table) -> pa.Table:
        """(word, near, near_n): the neighbourhood of each word, looked up among the words of its key."""
        batch = batch.combine_chunks()
        key = mixed(batch.column("key").to_numpy().view(np.uint64))
        _, group, often = np.unique(key, return_inverse=True, return_counts=True)
        batch = batch.filter(pa.array(often[group] > 1))  # a word alone in its key has none to meet
        key = key[often[group] > 1]
        words = batch.column("word").combine_chunks()
        size = np.array([len(w) for w in words.to_pylist()], np.int64)
        place, whole, n = batch.column("at").to_numpy(), batch.column("whole").to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
        kinds = list(zip(size.tolist(), place.tolist(), whole.tolist(), strict=True))
        order = sorted(range(len(kinds)), key=kinds.__getitem__)
        runs: dict[tuple[int, int, bool], list[int]] = {}
        for i in order:
            runs.setdefault(kinds[i], []).append(i)
        codes = {k: np.array(words.take(pa.array(rows)).to_pylist(), f"U{k[0]}").view(np.uint32).reshape(len(rows), k[0]) for k, rows in runs.items()}
        own = np.zeros(len(key), np.uint64)
        for k, rows in runs.items():
            own[rows] = key[rows] + word_hash(codes[k])
        listed, row_of = np.unique(own, return_index=True)
        seen = np.zeros(1 << 22, bool)  # most strings are no words: one look tells
        seen[(listed >> np.uint64(42)).astype(np.int64)] = True
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for k, rows in runs.items():
            for first in range(0, len(rows), CHUNK):
                part = np.array(rows[first : first + CHUNK])
                for near, counts in neighbourhood(codes[k][first : first + CHUNK], k[1], k[2], alphabet_codes):
                    near = near + key[part, None]
                    a, b = np.nonzero(seen[(near >> np.uint64(42)).astype(np.int64)] & counts)
                    wanted = near[a, b]
                    at = np.minimum(np.searchsorted(listed, wanted), len(listed) - 1)
                    hit = listed[at] == wanted
                    out[0].append(part[a[hit]])
                    out[1].append(row_of[at[hit]])
        left, right = (np.concatenate(x) for x in out)
        return pa.table({"word": words.take(pa.array(left)), "near": words.take(pa.array(right)), "near_n": pa.array(n[right], pa.int64())})

    return work


def _without_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, place, k1, k2): two hashes of a word without the letter at place; place -1 is the whole word, to meet a longer
    one's deletion."""
    for batch in batches:
        for i, word in enumerate(batch.column(0).to_pylist()):
            code = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            n = len(code)
            up, down = powers(n + 1)
            keys = []
            for seed in (0x51ED270B, 0x2545F491):
                term = mixed(code + np.uint64(seed)) * up[:n]
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
                left = total[:-1] + (total[-1] - total[1:]) * down[1]
                keys.append(np.concatenate([[total[-1]], left]).view(np.int64))
            for at in range(0, n + 1, 100_000):
                part = slice(at, min(n + 1, at + 100_000))
                size = part.stop - part.start
                yield pa.record_batch([pa.array(np.full(size, batch.column(1)[i].as_py())), pa.array(np.arange(part.start, part.stop) - 1), pa.array(keys[0][part]), pa.array(keys[1][part])], names=["id", "place", "k1", "k2"])


def long_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of the ``words`` (word, n) that are too long to write their neighbours out.

    Two differ by a replacement if they are alike without the letter at the same place, and by an insertion if one is what the
    other is without some letter. The strings are compared as two 64-bit hashes.
    """
    held = settle(words.select("word", "n", F.monotonically_increasing_id().alias("id")), "long-words")
    keyed = settle(held.select("word", "id").mapInArrow(_without_one, "id long, place long, k1 long, k2 long"), "long-keys")
    a, b = keyed.alias("a"), keyed.alias("b")
    same = (F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") == F.col("b.k2")) & (F.col("a.id") != F.col("b.id"))
    replaced = a.filter("a.place >= 0").join(b, same & (F.col("a.place") == F.col("b.place"))).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    shorter = a.filter("a.place >= 0").join(b.filter("b.place = -1"), same).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    pairs = replaced.unionByName(shorter).unionByName(shorter.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    named = pairs.join(held.select(F.col("id").alias("x"), "word"), "x").join(held.select(F.col("id").alias("y"), F.col("word").alias("near"), F.col("n").alias("near_n")), "y")
    return named.select("word", "near", "near_n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all two of ``words`` (word, n) that differ by one inserted, deleted or replaced code point."""
    placed = meeting_places(words)
    units = max(1, -(-words.agg(F.coalesce(F.sum(F.char_length("word")), F.lit(0))).first()[0] // UNIT_ROWS))
    met = placed.withColumn("unit", F.pmod("key", F.lit(units))).groupBy("unit").applyInArrow(_met(alphabet(words)), "word string, near string, near_n long")
    longer = words.filter(F.char_length("word") > WRITTEN)
    return met if longer.isEmpty() else met.unionByName(long_pairs(longer))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following ``forms`` (word, form) ends. Each step at least doubles the count, so chains are short and end;
    every round doubles the steps taken."""
    now = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = settle(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not stepped.filter("moved").isEmpty()
        discard(now)
        now = stepped.drop("moved")
        now._settled_at = stepped._settled_at
        if not moved:
            return now


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the texts of ``docs``.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that is twice the word's n or more. A null
    text has no words. Repeated rows count each. A table without words gives no rows. Other columns of ``docs`` are left out.
    """
    words = settle(vocabulary(docs, least_length, least_count), "words")
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    out = settle(
        words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= 2 * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("to"))
        .select("word", "n", "n_near", "to.form", "to.form_n"), "forms",
    )
    ends = roots(out.filter("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
