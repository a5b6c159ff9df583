"""Document fingerprints by order MinHash, with DataFrame functions only.

The k-mers are runs of five words and, the more the shorter a text is, of four code points, numbered by occurrence. (A word that
changes takes five runs of words with it, in a text of three words all; but texts that hardly differ in length take in
nearly the same runs.) For each of 64 permutations the two smallest of a text's k-mers are
taken, put in the order of the text, and hashed to one value. Likeness is the share of permutations whose values agree, so it
falls both with the k-mers that differ and with those that changed order.

The permutations are those of one hash whose first six bits are flipped by their number. So the hash deals the k-mers to 64
bins, and the two smallest under a permutation are the two least of its own bin, or where that has fewer, as in texts of few
k-mers, those of the bins that follow in the flipped order. One sort of a text's k-mers answers all permutations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, settle
from .secret_scan import let

K, BIN_BITS, PLACE_BITS = 5, 6, 28
#: Runs of so many code points are k-mers of short texts too: all up to EVERY code points, none from NONE on.
C, EVERY, NONE = 4, 120, 400
PLACE = (1 << PLACE_BITS) - 1


def _head(x: Column) -> Column:
    """The hash of a packed (hash, place)."""
    return x.bitwiseAND(F.lit(~PLACE))


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - BIN_BITS)


def _runs(n: Column, new: callable) -> Column:
    """Places from 0 to n - 1 at which ``new`` holds."""
    return F.filter(F.sequence(F.lit(0), n - 1), new)


def word_runs(text: Column) -> Column:
    """A hash for each five words in a row; one for all words of a text that has fewer; none without words."""

    def of_words(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(F.sequence(F.lit(0), F.greatest(n - K, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(K))))
        few = F.array(F.aggregate(h, F.lit(K).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(n >= K, runs).when(n > 0, few).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)), of_words)


def character_runs(text: Column) -> Column:
    """A hash for each four code points in a row, of those that the text's length lets in: all up to EVERY code points, from there
    on a share that falls with the cube of the length, none from NONE on. What a longer text lets in a shorter one does too."""
    n = F.length(text)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - C + 1, F.lit(1))), lambda i: F.xxhash64(F.substr(text, i, F.lit(C))))
    # the lowest bits let in, the highest order
    let_in = lambda r: r.bitwiseAND(F.lit((1 << 24) - 1)) * (n * n * n) < F.lit((1 << 24) * EVERY**3)
    return F.when(n < NONE, F.when(n <= EVERY, runs).otherwise(F.filter(runs, let_in))).otherwise(F.array().cast("array<bigint>"))


def kmer_hashes(text: Column) -> Column:
    """The hashes of a text's k-mers: its runs of words, then those of characters; none without words."""
    return let(word_runs(text), lambda w: F.when(F.size(w) > 0, F.concat(w, character_runs(text))).otherwise(w))


def fingerprint(text: Column) -> Column:
    """Array of 64 ints, one for each permutation: its number in the top bits, then the hash of its tuple; none without words."""

    def numbered(s: Column) -> Column:  # sorted (hash, place)
        n = F.size(s)
        starts = _runs(n, lambda i: (i == 0) | (_head(F.get(s, i)) != _head(F.get(s, i - 1))))

        def hashed(b: Column) -> Column:
            lengths = F.transform(b, lambda x, j: F.sequence(F.lit(0), F.coalesce(F.get(b, j + 1), n) - x - 1))
            return let(F.flatten(lengths), lambda occ: F.transform(s, lambda x, i: _head(F.xxhash64(_head(x), F.get(occ, i))).bitwiseOR(x.bitwiseAND(F.lit(PLACE)))))

        return F.sort_array(let(starts, hashed))

    def least(s: Column) -> Column:
        two = _runs(F.size(s), lambda i: (i < 2) | (_bin(F.get(s, i)) != _bin(F.get(s, i - 2))))
        return F.transform(two, lambda i: F.get(s, i))

    def value(bin_: Column, a: Column, b: Column) -> Column:
        """Of two packed k-mers, or one."""
        ahead = a.bitwiseAND(F.lit(PLACE)) < b.bitwiseAND(F.lit(PLACE))
        h = F.when(b.isNull(), F.xxhash64(_head(a))).when(ahead, F.xxhash64(_head(a), _head(b))).otherwise(F.xxhash64(_head(b), _head(a)))
        return F.shiftleft(bin_, 32 - BIN_BITS).bitwiseOR(F.shiftrightunsigned(h, 32 + BIN_BITS)).cast("int")

    def nearest(bin_: Column, some: Column) -> Column:
        """The value of a permutation from k-mers that hold its two smallest; the top bit is flipped to sort them as unsigned."""
        flip = F.shiftleft(bin_, 64 - BIN_BITS).bitwiseXOR(F.lit(-(1 << 63)))
        return let(F.slice(F.sort_array(F.transform(some, lambda x: x.bitwiseXOR(flip))), 1, 2), lambda two: value(bin_, F.get(two, 0), F.get(two, 1)))

    def tuples(e: Column) -> Column:
        two = _runs(F.size(e), lambda i: _bin(F.get(e, i)) == _bin(F.get(e, i + 1)))
        own = F.transform(two, lambda i: nearest(_bin(F.get(e, i)), F.array(F.get(e, i), F.get(e, i + 1))))
        every = F.sequence(F.lit(-(1 << BIN_BITS - 1)).cast("long"), F.lit((1 << BIN_BITS - 1) - 1).cast("long"))
        rest = F.array_except(every, F.transform(two, lambda i: _bin(F.get(e, i))))
        half = (1 << BIN_BITS - 1) >> 3
        groups = F.transform(F.sequence(F.lit(-half), F.lit(half - 1)), lambda g: F.filter(e, lambda x: F.shiftright(x, 67 - BIN_BITS) == g))  # of eight bins

        def filled(bins: Column) -> Column:
            return F.transform(rest, lambda b: let(F.get(bins, (F.shiftright(b, 3) + half).cast("int")), lambda g: nearest(b, F.when(F.size(g) > 1, g).otherwise(e))))

        return F.sort_array(F.concat(own, F.when(F.size(rest) > 0, let(groups, filled)).otherwise(F.array().cast("array<int>"))))

    packed = let(kmer_hashes(text), lambda ks: F.transform(ks, lambda h, i: _head(h).bitwiseOR(i.cast("long"))))
    none = F.array().cast("array<int>")
    chain = lambda p: let(F.sort_array(p), lambda s: let(numbered(s), lambda t: let(least(t), tuples)))
    return let(packed, lambda p: F.when(F.size(p) > 0, chain(p)).otherwise(none))


def likeness(a: Column, b: Column) -> Column:
    """Permutations that agree over all; 1 if neither text has words, 0 if one has none."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / float(1 << BIN_BITS))


def written(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda v: F.lpad(F.hex(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def next_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_chars, and the same of the next and the previous document, in the order of doc_id and text_key.

    Range partitions are ordered each on its own; the first and last rows of all partitions, one row a partition, join them.
    Equal rows are one document here; a null doc_id comes first; the last document's next is the first.
    """
    text = F.coalesce("text", F.lit(""))
    sizes = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.length(text).cast("long").alias("n_chars")).distinct()
    me = F.struct("doc_id", "text_key", "n_chars")
    ranged = settle(sizes.repartitionByRange("doc_id", "text_key").withColumn("part", F.spark_partition_id()), "document-order")
    ends = ranged.groupBy("part").agg(F.min(me).alias("first"), F.max(me).alias("last"))
    parts, whole = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first").over(parts), F.first("first").over(whole)).alias("after"),
        F.coalesce(F.lag("last").over(parts), F.last("last").over(whole)).alias("before"),
    )
    own = Window.partitionBy("part").orderBy("doc_id", "text_key")
    linked = ranged.withColumns({"next": F.lead(me).over(own), "prev": F.lag(me).over(own)}).join(ends, "part")
    return linked.select("doc_id", "text_key", "n_chars", F.coalesce("next", "after").alias("next"), F.coalesce("prev", "before").alias("prev"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each document.

    The edited text has its last quarter (rounded down) replaced by as much of the next document's beginning, or all of it. A
    null text is empty; empty texts have an empty fingerprint and are alike. Repeated rows stay and get equal values; a single
    document is its own next. Other columns of ``docs`` are left out.
    """
    links = settle(next_documents(docs), "document-links")
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    wanted = links.select(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"), "prev")
    same = lambda a, b: F.col("doc_id").eqNullSafe(F.col(a)) & (F.col("text_key") == F.col(b))
    beginnings = keyed.join(wanted, same("w_id", "w_key")).select(
        F.col("prev.doc_id").alias("p_id"), F.col("prev.text_key").alias("p_key"), F.substr("text", F.lit(1), F.floor(F.col("prev.n_chars") / 4).cast("int")).alias("beginning")
    )
    beginnings = beginnings.groupBy("p_id", "p_key").agg(F.first("beginning").alias("beginning"))
    n = F.length("text")
    kept = F.substr("text", F.lit(1), (n - F.floor(n / 4)).cast("int"))
    edited = keyed.join(beginnings, same("p_id", "p_key"), "left").withColumn("edited", F.concat(kept, F.coalesce("beginning", F.lit(""))))
    prints = edited.select(
        "doc_id", "text_key", n.cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("edited_sha"),
        fingerprint(F.col("text")).alias("fp"), fingerprint(F.col("edited")).alias("edited_fp"),
    )
    prints = settle(prints, "fingerprints")
    follow = links.select(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"), F.col("next.doc_id").alias("n_id"), F.col("next.text_key").alias("n_key"))
    # the next one's print goes to its predecessor, so that only one side of the last join is wide
    theirs = prints.select("doc_id", "text_key", "fp").dropDuplicates(["doc_id", "text_key"])
    theirs = theirs.join(follow, F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("text_key") == F.col("n_key"))).select("w_id", "w_key", F.col("fp").alias("next_fp"))
    out = prints.join(theirs, same("w_id", "w_key"), "left")
    return out.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"), written(F.col("fp")).alias("fingerprint"), written(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.coalesce("next_fp", F.array().cast("array<int>"))).alias("near_next"),
    )
