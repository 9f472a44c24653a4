"""The compression classifier: held-out accuracy, scores against plain zstandard, what may and may not teach it."""

import math
import random
import zlib

import numpy as np
import pytest
import zstandard

from shelfmark.llm import compression
from shelfmark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def remainder(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels")]


@pytest.fixture(scope="module")
def model(tables):
    docs, labels = tables
    may = [i for i in (r.doc_id for r in labels.collect()) if remainder(i) != 0]
    teach = labels.where(labels.doc_id.isin(may)).select("doc_id", labels.quality.alias("label"))
    return compression.fit(docs.select("doc_id", "text"), teach)


def plain_score(model, text):
    sizes = []
    for d in (model.good, model.bad):
        maker = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        raw = (text or "").encode()
        sizes.append(sum(len(maker.compress(raw[i:i + 1024])) for i in range(0, len(raw), 1024)))
    good, bad = sizes
    x = (bad - good) / (bad + good) if bad + good else 0
    return 1 / (1 + math.exp(-(model.slope * x + model.offset)))


def test_held_out_accuracy_and_plain_scores(spark, tables, model):
    docs, labels = tables
    texts = {r.doc_id: r.text for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = QUERIES["op12_compression_quality"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (remainder(r.doc_id) == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    assert np.mean([p == q for p, q in held]) >= 0.95
    assert np.mean([p for p, q in held if q]) >= 0.99
    assert np.mean([not p for p, q in held if not q]) >= 0.7
    for r in random.Random(3).sample(rows, 300):
        assert r.score == pytest.approx(plain_score(model, texts[r.doc_id]), abs=1e-9)
    # calibrated: among held-out rows the mean score is the share of good ones
    scores = [r.score for r in rows if r.held_out and r.doc_id in quality]
    assert np.mean(scores) == pytest.approx(np.mean([q for _, q in held]), abs=0.03)


def test_held_out_labels_and_other_columns_teach_nothing(spark, tmp_path):
    small = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{small}/{name}.parquet").toPandas() for name in ("documents", "labels"))
    before = {r.doc_id: r.score for r in QUERIES["op12_compression_quality"](spark, small).collect()}
    held = labels.doc_id.map(remainder) == 0
    labels.loc[held, "quality"] = 1 - labels.loc[held, "quality"]
    docs["lang"], docs["source"], docs["score"] = "xx", "elsewhere", "a"
    docs = docs.sample(frac=1, random_state=1)
    for name, table in (("documents", docs), ("labels", labels)):
        spark.createDataFrame(table).write.parquet(f"{tmp_path}/{name}.parquet")
    assert {r.doc_id: r.score for r in QUERIES["op12_compression_quality"](spark, str(tmp_path)).collect()} == before


def test_odd_rows(spark, model):
    rows = [(None, None), (1, None), (1, ""), (2, "ä"), (2, "ä"), (3, "word " * 100_000), (4, "\x00\n"), (None, "the and of")]
    docs = spark.createDataFrame([(*r, 1, "c", 0.5) for r in rows], "doc_id long, text string, row int, difference string, score double")
    found = compression.score(docs, model)
    assert found.columns == ["doc_id", "text", "row", "difference", "score"]
    got = found.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str)
    for r in got:
        assert r.score == pytest.approx(plain_score(model, r.text), abs=1e-9) and r.row == 1 and r.difference == "c"
    assert compression.score(docs.limit(0), model).count() == 0


def test_few_labels_or_none(spark):
    docs = spark.createDataFrame([(1, "good words here"), (1, "good words here"), (2, "BAD!! BAD!!"), (3, None), (None, "x"), (4, "")], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(2, 0)], [(1, 1), (1, 1), (2, 0), (3, 0), (None, 1), (4, None), (4, 7), (9, 1)], [(1, 0), (1, 1)]):
        made = compression.fit(docs, spark.createDataFrame(labels, "doc_id long, label int"))
        assert all(0 <= r.score <= 1 for r in compression.score(docs, made).collect())
    empty = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in compression.score(docs, compression.fit(docs.limit(0), empty)).collect()} == {0.5}


def test_pieces_are_whole_texts(spark):
    texts = ["", "a", "é" * 3000, "x" * 1024, "x" * 1025]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in docs.select("text", compression._pieces(docs.text).alias("p")).collect():
        assert b"".join(map(bytes, r.p)) == r.text.encode() and all(0 < len(p) <= 1024 for p in r.p)
