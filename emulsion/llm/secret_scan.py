"""Secret scans with DataFrame functions only: fixed patterns, and character Markov models of long tokens.

Two first-order Markov models over 67 characters are counted from labelled samples: random strings, and ordinary words and
identifiers. Spans of fixed patterns are blanked first. A token of ``LEAST_TOKEN`` characters or more of what is left whose
log-likelihood ratio is high enough for its length is a span of kind ``random``; so is a piece between separators, and in a
token that isn't one as a whole each stretch that is, widened to the separators around it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the task: kind, pattern, least length of the match (of the second group for assign).
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN, ACCESS, HEX = ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]+", "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
LEAST_VALUE = 8

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LEAST_TOKEN = 16
#: Below so many characters a span needs a letter: bare numbers of 16 to 19 digits are those of cards and accounts.
LEAST_NUMBER = 20
TOKEN, PIECE = "[A-Za-z0-9+/_=-]{%d,}" % LEAST_TOKEN, "[A-Za-z0-9]{%d,}" % LEAST_TOKEN
#: A token is random if its ratio is above LEAST_RATIO and above RATIO_PER_CHAR for each character.
LEAST_RATIO, RATIO_PER_CHAR = 8.0, 0.35
#: Share of a character's own frequency in the chance that it follows another: a pair of common letters that no sample has isn't odd.
ALONE = 0.3
#: Documents, in expectation, whose words are samples of ordinary text, and random strings of each form.
SAMPLE_DOCS, SAMPLE_RANDOM = 2000, 3000
KINDS = ("assign", "access", "hex", "random")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running results of ``merge`` over an array of ints, in rounds of doubled steps: no array grows element by element."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def step(acc: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(acc, lambda x, i: F.when(i >= back, merge(x, F.get(acc, i - back))).otherwise(x))

    return F.aggregate(rounds, values, step)


def added(a: Column, b: Column) -> Column:
    return a + b


SPAN = "struct<start:int,kind:int,end:int,at:int,to:int,match:string>"


def found(text: Column, pattern: str, kind: int, fits: Callable[[Column], Column] | None = None) -> Column:
    """Spans of the leftmost non-overlapping matches as structs (start, kind, end, at, to, match): code points, then bytes.

    The text is cut into pairs of a gap and a match; the last gap goes to the end of the text, so the scan is linear.
    """
    pairs = rf"(?s)(.*?)({pattern}|\z)"
    cut = F.arrays_zip(F.regexp_extract_all(text, F.lit(pairs), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(pairs), F.lit(2)).alias("match"))
    none = F.array().cast(f"array<{SPAN}>")

    def placed(c: Column) -> Column:
        ends = lambda size: running(F.transform(c, lambda x: size(x["gap"]) + size(x["match"])), added)
        return let(F.struct(ends(F.length).alias("chars"), ends(F.octet_length).alias("bytes")), lambda e: F.transform(c, lambda x, i: span(x, F.get(e["chars"], i), F.get(e["bytes"], i))))

    def span(x: Column, end: Column, to: Column) -> Column:
        start, at = end - F.length(x["match"]), to - F.octet_length(x["match"])
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), at.alias("at"), to.alias("to"), x["match"].alias("match"))

    keep = lambda x: (x["match"] != "") & (fits(x["match"]) if fits is not None else F.lit(True))
    return F.when(text.rlike(pattern), F.filter(let(cut, placed), keep)).otherwise(none)


def pairs_of(token: Column) -> Column:
    """Numbers of the neighbouring characters' pairs in the table, from 1."""
    n = len(ALPHABET)
    return let(
        F.filter(F.transform(F.regexp_extract_all(token, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c) - 1), lambda p: p >= 0),
        lambda at: F.when(F.size(at) > 1, F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda i: F.get(at, i) * n + F.get(at, i + 1) + 1)).otherwise(F.array().cast("array<int>")),
    )


def labelled_samples(docs: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """token, random: made-up random strings; words, and identifiers of four words in six forms by turns, from about ``sample`` documents."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 512)
    forms = (digest, F.base64(F.unhex(digest)), F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", ""), F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "")), F.translate(F.base64(F.unhex(digest)), "+/", "-_"))
    random = spark.range(SAMPLE_RANDOM).select(F.explode(F.array(*(F.substring(f, 1, 40) for f in forms))).alias("token"), F.lit(True).alias("random"))
    n = max(1, docs.count())
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) < sample)
    words = drawn.select(F.regexp_extract_all("text", F.lit("(?<![A-Za-z0-9])[A-Za-z]{2,24}(?![A-Za-z0-9])"), F.lit(0)).alias("w"))
    fours = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / 4).cast("int") - 1), lambda i: F.slice("w", i * 4 + 1, 4))
    forms_of = [lambda g, sep=sep: F.array_join(g, sep) for sep in ("_", "-", "/", "")]
    forms_of += [lambda g: F.array_join(F.transform(g, lambda x: F.initcap(x)), ""), lambda g: F.upper(F.array_join(g, "_"))]
    identifiers = F.transform(fours, lambda g, i: reduce(lambda c, k: c.when(i % len(forms_of) == k, forms_of[k](g)), range(1, len(forms_of)), F.when(i % len(forms_of) == 0, forms_of[0](g))))
    ordinary = words.filter(F.size("w") > 0).select(F.explode(F.concat(identifiers, F.col("w"))).alias("token"), F.lit(False).alias("random"))
    fixed = [(c * 8000, False) for c in ALPHABET] + [(f"20{y:02d}-{m:02d}-{d:02d}", False) for y in range(10, 40) for m in range(1, 13) for d in range(1, 29, 3)]
    return random.unionByName(ordinary).unionByName(spark.createDataFrame(fixed, "token string, random boolean"))


def fit(samples: DataFrame) -> list[float]:
    """Log-ratio of the transition probabilities (random to ordinary) for each pair of characters."""
    n = len(ALPHABET)
    rows = samples.select("random", F.explode(pairs_of(F.col("token"))).alias("pair")).groupBy("pair").agg(F.count_if("random").alias("a"), F.count_if(~F.col("random")).alias("b")).collect()
    count = np.full((2, n * n), 0.5)
    for r in rows:
        count[:, r["pair"] - 1] += (r["a"], r["b"])
    count = count.reshape(2, n, n)
    alone = count.sum(axis=1, keepdims=True) / count.sum(axis=(1, 2), keepdims=True)
    logs = np.log((1 - ALONE) * count / count.sum(axis=2, keepdims=True) + ALONE * alone)
    return [round(float(x), 4) for x in (logs[0] - logs[1]).reshape(-1)]


def ratio(token: Column, table: list[float]) -> Column:
    values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    return F.aggregate(pairs_of(token), F.lit(0.0), lambda acc, p: acc + F.element_at(values, p))


def replaced(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """``text`` with ``fill(span, end of what came before)`` in place of the spans, which are sorted and may overlap.

    Gaps are cut out of the bytes, so a cut costs no more than what it yields.
    """

    def joined(x: Column) -> Column:
        before = lambda name, i: F.coalesce(F.get(x[name], i - 1), F.lit(0))
        between = lambda a, b: F.substr(x["bytes"], a + 1, F.greatest(b - a, F.lit(0))).cast("string")
        parts = F.transform(spans, lambda s, i: F.concat(between(before("to", i), s["at"]), fill(s, before("end", i))))
        return F.concat(F.array_join(parts, ""), between(F.element_at(x["to"], -1), F.octet_length(x["bytes"])))

    reach = [running(spans[n], F.greatest).alias(n) for n in ("to", "end")]
    return F.when(F.size(spans) > 0, let(F.struct(text.cast("binary").alias("bytes"), *reach), joined)).otherwise(text)


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with spaces in place of the spans; positions in code points stay."""
    return replaced(text, spans, lambda s, before: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(before, s["start"]), F.lit(0))))


#: A token is walked through in parts of so many characters: each step copies its state, so the spans found so far stay out of it.
PART = 1024


def stretches(token: Column, table: list[float]) -> Column:
    """Spans in a token where the ratio stays above RATIO_PER_CHAR a character, until it falls LEAST_RATIO below its peak."""
    values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def state(at: Column, start: Column, total: Column, peak: Column, stop: Column, spans: Column) -> Column:
        return F.struct(at.alias("at"), start.alias("start"), total.alias("total"), peak.alias("peak"), stop.alias("stop"), spans.alias("spans"))

    def closed(acc: Column) -> Column:
        n = acc["stop"] - acc["start"]
        good = (n >= LEAST_TOKEN) & (acc["peak"] > 0) & (acc["peak"] + RATIO_PER_CHAR * n > LEAST_RATIO)
        return F.when(good, F.array_append(acc["spans"], F.struct(acc["start"].alias("start"), acc["stop"].alias("stop")))).otherwise(acc["spans"])

    def step(acc: Column, p: Column) -> Column:
        def moved(total: Column) -> Column:
            new = acc["at"] + 1
            over = (total <= 0) | (total < acc["peak"] - LEAST_RATIO)
            fresh = state(new, new, F.lit(0.0), F.lit(0.0), new, closed(acc))
            higher = total > acc["peak"]
            on = state(new, acc["start"], total, F.greatest(total, acc["peak"]), F.when(higher, new + 1).otherwise(acc["stop"]), acc["spans"])
            return F.when(over, fresh).otherwise(on)

        return let(acc["total"] + F.element_at(values, p) - RATIO_PER_CHAR, moved)

    def part(acc: Column, pairs: Column) -> Column:
        begun = state(*(acc["now"][c] for c in ("at", "start", "total", "peak", "stop")), none)
        return let(F.aggregate(pairs, begun, step), lambda now: F.struct(now.alias("now"), F.concat(acc["found"], now["spans"]).alias("found")))

    # the last part's spans are in ``found`` already
    last = lambda acc: F.concat(acc["found"], closed(state(*(acc["now"][c] for c in ("at", "start", "total", "peak", "stop")), none)))
    first = F.struct(state(F.lit(0), F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0), none).alias("now"), none.alias("found"))
    parts = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0)), F.lit(PART)), lambda k: F.slice(p, k + 1, PART))
    return let(pairs_of(token), lambda p: F.aggregate(parts(p), first, part, last))


def separators(c: Column) -> Column:
    """For each of the characters ``c`` the place of the last separator up to it, or -1."""
    return running(F.transform(c, lambda x, i: F.when(x.rlike("[A-Za-z0-9]"), F.lit(-1)).otherwise(i)), F.greatest)


def widened(token: Column, found_: Column) -> Column:
    """Stretches of a token as spans of the text, each out to the separators around it.

    Where these are is told for all places of the token at once, by running maxima from either side.
    """
    text = token["match"]

    def placed(at: Column) -> Column:
        n = F.size(at["before"])

        def span(x: Column) -> Column:
            start = F.when(x["start"] > 0, F.get(at["before"], x["start"] - 1) + 1).otherwise(0)
            stop = F.when(x["stop"] < n, n - 1 - F.get(at["after"], n - 1 - x["stop"])).otherwise(n)
            return let(F.struct(start.alias("a"), stop.alias("b")), ends)

        def ends(w: Column) -> Column:
            moved = [(token[k] + w[m]).alias(o) for o, k, m in (("start", "start", "a"), ("end", "start", "b"), ("at", "at", "a"), ("to", "at", "b"))]
            return F.struct(moved[0], token["kind"].alias("kind"), *moved[1:], F.substr(at["raw"], w["a"] + 1, w["b"] - w["a"]).cast("string").alias("match"))

        return F.transform(found_, span)

    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    sides = lambda c: F.struct(separators(c).alias("before"), separators(F.reverse(c)).alias("after"), text.cast("binary").alias("raw"))
    return let(let(chars, sides), placed)


def outermost(spans: Column) -> Column:
    """Spans by start and then falling end, without those inside another or equal to one before."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def kept(s: Column) -> Column:
        far = running(F.transform(s, lambda x: x["end"]), F.greatest)
        return let(far, lambda f: F.filter(s, lambda x, i: (i == 0) | (x["end"] > F.get(f, i - 1))))

    return let(order, kept)


def random_spans(text: Column, table: list[float]) -> Column:
    """Spans of kind random of a text whose fixed spans are blanked; none lies inside another."""
    likely = lambda m: ratio(m, table) > F.greatest(F.lit(LEAST_RATIO), RATIO_PER_CHAR * F.length(m))
    spread = lambda t: let(stretches(t["match"], table), lambda x: F.when(F.size(x) > 0, widened(t, x)).otherwise(F.array().cast(f"array<{SPAN}>")))
    wide = F.flatten(F.transform(found(text, TOKEN, 3), lambda t: F.when(likely(t["match"]), F.array(t)).otherwise(spread(t))))
    pieces = found(text, PIECE, 3, likely)
    every = F.filter(F.concat(wide, pieces), lambda x: (F.length(x["match"]) >= LEAST_NUMBER) | x["match"].rlike("[A-Za-z]"))
    return F.when(text.rlike(TOKEN), outermost(every)).otherwise(F.array().cast(f"array<{SPAN}>"))


def secret_spans(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """``docs`` plus secret_base and secret_spans, arrays of (start, kind, end, at, to, match) by start, then kind.

    start and end are code points from 0, at and to bytes of the UTF-8 text, ends exclusive; kinds count from 0 in the order of ``KINDS``. A null or empty text has
    none. Repeated rows stay; columns of those names in ``docs`` are replaced.
    """
    docs = docs.drop("secret_base", "secret_spans")
    table = fit(labelled_samples(docs)) if table is None else table
    text = F.coalesce("text", F.lit(""))
    value = lambda m: F.length(F.regexp_replace(m, "^" + ASSIGN_HEAD, "")) >= LEAST_VALUE
    base = F.array_sort(F.concat(found(text, ASSIGN, 0, value), found(text, ACCESS, 1), found(text, HEX, 2)))
    out = docs.withColumn("secret_base", base).withColumn("_left", blanked(text, F.col("secret_base")))
    return out.withColumn("secret_spans", F.array_sort(F.concat("secret_base", random_spans(F.col("_left"), table)))).drop("_left")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each document."""
    got = secret_spans(docs.select("doc_id", "text"), table)
    n = lambda kind: F.size(F.filter("secret_base", lambda s: s["kind"] == kind)).cast("long")
    return got.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(written(F.col("secret_base")), 256).alias("base_sha256"), written(F.col("secret_spans")).alias("spans"),
    )


def redact(docs: DataFrame, table: list[float] | None = None, mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with each stretch of overlapping spans replaced by ``mark``; n_chars, where there is one, is set anew."""
    got = secret_spans(docs, table)
    clean = replaced(F.col("text"), F.col("secret_spans"), lambda s, before: F.when(s["start"] >= before, F.lit(mark)).otherwise(""))
    out = got.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
