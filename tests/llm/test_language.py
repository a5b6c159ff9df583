from __future__ import annotations

import math

import numpy as np
from emulsion.llm import language
from emulsion.llm.common import table
from emulsion.llm.grams import SIZE
from pyspark.sql import functions as F

from . import corpus


def test_documents_and_pages(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    got = language.identify_documents(docs).collect()
    assert len(got) == docs.count() and np.mean([r["lid_lang"] == r["lang"] for r in got]) > 0.98
    assert np.mean([r["lid_text"] == r["lang"] for r in got]) > 0.97 and all(r["lid_kept"] for r in got if (r["text"] or "").split() and r["lid_posterior"] >= 0.5)
    pages = language.identify_pages(table(spark, sf, "pages"), docs).collect()
    assert np.mean([r["lid_lang"] == r["declared"] for r in pages if r["declared"]]) > 0.9
    unseen = language.identify_pages(table(spark, sf, "pages"), docs, markup=False).collect()
    assert np.mean([r["lid_lang"] == r["declared"] for r in unseen if r["declared"]]) > 0.85


def test_fit_matches_counts_by_hand(spark):
    rows = [(1, "aab ab", "x"), (2, "zz top", "y"), (3, "zzz", "y"), (4, " ", "y"), (5, None, "x"), (6, "no label", None)]
    langs, got = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == ["x", "y"]
    own = np.zeros((SIZE, 2))
    for _, text, lang in rows:
        if text and text.strip() and lang:
            np.add.at(own[:, langs.index(lang)], language.trigram_codes(text), 1)
    own /= own.sum(axis=0)
    want = (1 - language.MEAN_SHARE - language.EVEN_SHARE) * own + language.MEAN_SHARE * own.mean(axis=1, keepdims=True) + language.EVEN_SHARE / SIZE
    assert np.allclose(got, np.log(want), atol=1e-5)


def test_what_is_no_language_goes(spark):
    rng = np.random.default_rng(4)
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    langs, model = language.fit(docs)
    noise = ["".join(chr(x) for x in rng.integers(33, 127, 200)) for _ in range(20)] + ["".join(chr(x) for x in rng.integers(0x4E00, 0x9000, 80)) for _ in range(20)]
    got = language.identify(spark.createDataFrame([(i, t) for i, t in enumerate([*noise, "the house was old", "quite short"])], "doc_id long, text string"), langs, model)
    assert [r["doc_id"] for r in got.orderBy("doc_id").collect() if r["lid_kept"]] == [40, 41]


def brute(rows, langs, table_):
    """Posterior by hand: log-likelihoods, host shares smoothed twice, declared counts."""
    from emulsion.llm.grams import trigram_codes

    lls = []
    for text, _, _ in rows:
        codes = trigram_codes(text) if text and not text.isspace() else np.zeros(0, np.int32)
        ll = table_[codes].sum(axis=0, dtype=np.float64) * min(1.0, language.MOST_GRAMS / max(1, len(codes)))
        lls.append(np.round(ll - ll.max(), 9))
    told = [i for i, ll in enumerate(lls) if ll.sum() < 0]
    best = {i: int(np.argmax(lls[i] == 0)) for i in told}
    n = len(langs)
    total = np.array([sum(best[i] == k for i in told) for k in range(n)], dtype=float)
    whole = (total + 1) / (len(told) + n)
    count = lambda key, value: np.array([sum(best[i] == k and key(rows[i]) == value for i in told) for k in range(n)], dtype=float)
    parent = lambda h: None if h is None else ".".join(h.split(".")[-2:])
    kinds = len({rows[i][1] for i in told if rows[i][1] is not None})
    out = []
    for (_text, declared, host), ll in zip(rows, lls, strict=True):
        share = whole
        if host is not None and any(rows[i][2] == host for i in told):
            d, h = count(lambda r: parent(r[2]), parent(host)), count(lambda r: r[2], host)
            domain = (d + language.DOMAIN_PRIOR * whole) / (d.sum() + language.DOMAIN_PRIOR)
            share = (h + language.HOST_PRIOR * domain) / (h.sum() + language.HOST_PRIOR)
        s = ll + np.log(share)
        if declared is not None and any(rows[i][1] == declared for i in told):
            s = s + np.log((count(lambda r: r[1], declared) + 1) / (total + kinds + 1))
        p = np.exp(s - s.max())
        out.append((langs[int(np.argmax(s))], float(p.max() / p.sum())))
    return out


def test_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    langs, table_ = ["aa", "bb", "cc"], rng.normal(-9, 0.02, (SIZE, 3)).astype(np.float32)
    rows = [(corpus.sentence(i, int(rng.integers(1, 8))), [None, "aa", "bb"][i % 3], [None, "x.site.com", "y.site.com", "lone"][i % 4]) for i in range(60)] + [(None, "aa", "lone"), ("", None, None), ("  ", "zz", "new.host")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, lang string, source string")
    got = language.identify(df, langs, table_, declared=F.col("lang"), host=F.col("source")).orderBy("i").collect()
    for r, (lang, p) in zip(got, brute(rows, langs, table_), strict=True):
        assert r["lid_lang"] == lang and math.isclose(r["lid_posterior"], p, rel_tol=1e-6), r
        assert r["lid_kept"] == (bool((r["text"] or "").strip()) and p >= 0.5 and r["lid_fit"] >= -language.LEAST_FIT)


def test_edges(spark):
    docs = corpus.documents(spark).withColumn("lid_lang", F.lit("old")).withColumn("best", F.lit(1)).withColumn("_host", F.lit("h")).withColumn("_ll", F.lit("l")).withColumn("host_share", F.lit(2))
    out = language.identify_documents(docs)
    assert [c for c in out.columns if not c.startswith("lid_")] == [c for c in docs.columns if c != "lid_lang"]
    assert out.filter("_host != 'h' or _ll != 'l' or host_share != 2").count() == 0
    assert out.count() == docs.count() and out.filter("lid_kept is null").count() == 0
    assert out.filter("lid_kept and (text is null or trim(text) = '')").count() == 0
    assert language.identify_documents(corpus.empty(spark)).count() == 0
    unlabelled = corpus.documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert language.identify_documents(unlabelled).filter("lid_kept").count() == 0


def test_every_labelled_language_has_a_model(spark):
    rng = np.random.default_rng(8)

    def words(letters, n):
        return " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))

    rows = [(i, words("abcdefgh", 30), "aa") for i in range(1500)] + [(2000 + i, words("ijklmnop", 30), "bb") for i in range(1500)]
    rows += [(5000 + i, words("qrstuvwx", 12), "rare") for i in range(5)] + [(None, words("yz", 12), "equal")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table_ = language.fit(df, sample=100)
    assert langs == ["aa", "bb", "equal", "rare"]
    got = language.identify(df, langs, table_).collect()
    assert len(got) == len(rows) and all(r["lid_lang"] == r["lang"] for r in got)


def test_three_hundred_labels(spark):
    """More labels than a block of languages: all have a model, and each text is told among all of them."""
    rows = [(1000 * k + i, f"word{k}x{i % 3} quick{k} and{k} {'abcdefghij'[k % 10] * 3}{k}z " * 6, f"l{k:03d}", "src") for k in range(300) for i in range(4)]
    rows += [(400_000 + i, r[1], r[2].upper() + "-XX", "src") for i, r in enumerate(rows[:12])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = language.identify_documents(docs).collect()
    assert len(got) == len(rows) and all(r["lid_kept"] for r in got)
    assert np.mean([r["lid_text"].lower()[:4] == r["lang"].lower()[:4] for r in got]) > 0.99
    assert np.mean([r["lid_lang"] == r["lang"] for r in got if r["doc_id"] < 400_000]) > 0.95


def test_blocks_of_languages_change_nothing(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    told = lambda: sorted((r["doc_id"], r["lid_lang"], round(r["lid_posterior"], 6), round(r["lid_fit"], 4), r["lid_kept"]) for r in language.identify_documents(docs).collect())
    whole = told()
    monkeypatch.setattr(language, "BLOCK", 3)
    assert told() == whole


def test_held_out_texts_without_their_declared_language(spark):
    """Fitted on four fifths of the labelled texts, told on the last fifth from the text alone."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(5)))
    model = language.fit_model(docs.filter("fold > 0"))
    got = language.identify(docs.filter("fold = 0"), model.langs, model).filter("trim(text) != ''").collect()
    assert len(got) > 100 and np.mean([r["lid_text"] == r["lang"] for r in got]) >= 0.97


def test_text_of_ten_megabytes(spark):
    docs = spark.createDataFrame([(1, "the house was old " * 560_000, "en", "a"), (2, "das Haus war alt " * 50, "de", "a")], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in language.identify_documents(docs).collect()}
    assert got[1]["lid_lang"] == "en" and got[2]["lid_lang"] == "de" and got[1]["lid_kept"]
