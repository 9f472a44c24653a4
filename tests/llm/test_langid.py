"""Language identification: held-out accuracy, each kind of evidence, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import langid
from shelfmark.llm.queries import LANGUAGES, QUERIES

FOLDER = "/root/testdata/sf0.01"


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_held_out_accuracy_of_text_alone(spark):
    docs = documents(spark)
    model = langid.fit(docs.where("doc_id % 2 = 0"), LANGUAGES)
    judged = langid.identify(docs.where("doc_id % 2 = 1"), LANGUAGES, model)
    right = judged.agg(F.avg((F.col("_language") == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.95


def test_query_accepts_clean_documents(spark):
    rows = QUERIES["op8_language_id"](spark, FOLDER)
    assert rows.count() == documents(spark).count()
    assert rows.where("accepted and language = declared").count() >= 0.97 * rows.count()


def test_pages_use_markup_and_address(spark):
    rows = QUERIES["language_id_of_pages"](spark, FOLDER)
    marked = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", langid.markup_language(F.col("html")).alias("told"))
    assert rows.join(marked, "page_id").where("told is null or language = told").count() >= 0.9 * rows.count()


def test_fusion_equals_plain_bayes(spark):
    """Priors by host and suffix, and the declared language, decide where the text says little."""
    model = np.full((1 << langid.BITS, 3), -1.0, dtype=np.float32)
    a, b = langid._buckets(b"aaa")[0], langid._buckets(b"bbb")[0]
    model[a, 0] = -0.5
    model[b, 1] = -0.5
    rows = [(i, "aaa", None, "h.aa", "aa") for i in range(30)] + [(100 + i, "bbb", None, "h.bb", "bb") for i in range(10)]
    rows += [(200, "ccc", None, "h.aa", "aa"), (201, "ccc", None, "new.bb", "bb"), (202, "ccc", "y", "h.aa", "aa"),
             (203, "ccc", None, None, None), (204, None, "x", "h.aa", "aa"), (205, "", None, None, None), (200, "ccc", None, "h.aa", "aa")]
    docs = spark.createDataFrame(rows, "id long, text string, lang string, host string, suffix string")
    judged = langid.identify(docs, ("x", "y"), model, declared=F.col("lang"), host=F.col("host"), suffix=F.col("suffix")).collect()
    assert len(judged) == len(rows)

    best = {i: (None if not t else int(np.argmax(model[langid._buckets(t.encode())[0]]))) for i, t, *_ in rows}
    counts = {}
    for i, t, _, h, s in rows:
        if t:
            for level in ((), (s,), (s, h)):
                counts.setdefault(level, np.zeros(3))[best[i]] += 1

    def smooth(level, above):
        c = counts.get(level, np.zeros(3))
        return (c + langid.STRENGTH * above) / (c.sum() + langid.STRENGTH)
    for r in judged:
        if not r.text:
            assert (r._language, r._confidence, r._accepted) == (langid.UNKNOWN, 1.0, False)
            continue
        prior = smooth((r.suffix, r.host), smooth((r.suffix,), smooth((), np.full(3, 1 / 3))))
        told = np.array([langid.TRUST if r.lang == n else 1 - langid.TRUST for n in ("x", "y")] + [0.5]) if r.lang else np.ones(3)
        score = model[langid._buckets(r.text.encode())[0]] + np.log(prior) + np.log(told)
        assert r._language == ("x", "y", langid.UNKNOWN)[int(np.argmax(score))]
        assert abs(r._confidence - 1 / np.exp(score - score.max()).sum()) < 1e-5


def test_odd_tables(spark):
    docs = documents(spark).withColumn("_scores_", F.lit(1)).withColumn("host", F.lit("clash"))
    model = langid.fit(docs.limit(0), LANGUAGES)
    assert langid.identify(docs.limit(0), LANGUAGES, model).count() == 0
    judged = langid.identify(docs.limit(5), LANGUAGES, model)
    assert judged.columns == [*docs.columns, "_language", "_confidence", "_accepted"] and judged.count() == 5


def test_chunks_hold_each_trigram_once(monkeypatch):
    text = bytes(range(256)) * 40
    whole = np.bincount(langid._buckets(text.lower()), minlength=1 << langid.BITS)
    monkeypatch.setattr(langid, "CHUNK", 77)
    assert (langid._count([text]) == whole).all()


def test_address_suffix_and_markup(spark):
    rows = spark.createDataFrame([("A.b.DE", '<html lang="fr-CA">'), ("local", "<html>"), (None, None), ("x.", "<HTML dir=ltr LANG=es>")], "h string, m string")
    found = [tuple(r) for r in rows.select(langid.address_suffix(F.col("h")), langid.markup_language(F.col("m"))).collect()]
    assert found == [("de", "fr"), (None, None), (None, None), (None, "es")]
