"""The pipeline, stage by stage, against brute force on the smallest tables."""

import collections
import hashlib
import math

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from shelfmark.llm import bpe
from shelfmark.llm.queries import VOCABULARY
from tests.llm.test_simhash import plain_classes, plain_fingerprint
from tests.llm.test_substrings import plain as plain_substrings

FOLDER = "/root/testdata/sf0.001"
COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def steps(spark):
    """The rows of documents and those of each stage, with some odd rows among the documents."""
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0), (5, documents.where("doc_id = 5").first().text, "en", None, 1),
           (10**6 + 2, "The and of the in this with that is for on are by from", None, None, 55), (None, "The of and to in that it is", "en", "src1", 27)]
    docs = documents.unionByName(spark.createDataFrame(odd, documents.schema))
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.stored(stage(spark, frames[-1], FOLDER), "test-stage")
        frames.append(path)
    return [[r.asDict() for r in f.collect()] for f in frames]


def test_names_and_columns(spark, steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "source_mixing", "tokenize"]
    assert all(list(rows[0]) == COLUMNS for rows in steps[:-1])


def test_language_stage_keeps_clean_documents(steps):
    kept = {r["doc_id"] for r in steps[1]}
    texts = [r for r in steps[0] if r["text"]]
    assert sum(r["doc_id"] in kept for r in texts) >= 0.97 * len(texts)
    assert not kept & {10**6, 10**6 + 1}


def test_one_of_each_class_stays(steps):
    prints = collections.defaultdict(list)
    for r in steps[1]:
        prints[plain_fingerprint(r["text"])].append(r["doc_id"])
    groups = collections.defaultdict(list)
    for p, root in plain_classes(set(prints)).items():
        groups[root] += prints[p]
    wanted = [min((i for i in ids if i is not None), default=None) for ids in groups.values()]
    assert sorted(map(str, wanted)) == sorted(str(r["doc_id"]) for r in steps[2])
    assert all(r in steps[1] for r in steps[2])


def test_repeats_go(steps):
    found = plain_substrings([(r["doc_id"], r["text"]) for r in steps[2]])
    assert any(spans for *_, spans in found)
    wanted = sorted((str(i), t) for i, t, spans in found if not spans or t.strip())
    assert sorted((str(r["doc_id"]), r["text"]) for r in steps[3]) == wanted


def test_mix_takes_what_weights_ask_for(steps):
    sizes = collections.Counter()
    for r in steps[3]:
        sizes[r["source"]] += len(r["text"].encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        above = {s for s in free if 3 * sizes[s] <= level * weight[s]}
        if not above:
            break
        capped |= above
    wanted = collections.Counter()
    for r in steps[3]:
        s = r["source"]
        rate = 3.0 if s in capped else min(3.0, level * weight[s] / sizes[s])
        key = "" if r["doc_id"] is None else r["doc_id"]
        draw = int(hashlib.md5(f"42:{key}".encode()).hexdigest()[:13], 16) / 16**13
        wanted[r["doc_id"]] += math.floor(rate) + (draw < rate - math.floor(rate))
    assert +wanted == collections.Counter(r["doc_id"] for r in steps[4])


def test_tokens_are_the_librarys(steps):
    ranks = bpe.load(public_tokenizers.path(VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.of, special_tokens={})
    wanted = sorted((str(r["doc_id"]), library.encode_ordinary(r["text"])) for r in steps[4])
    assert sorted((str(r["doc_id"]), r["ids"]) for r in steps[5]) == wanted
    assert all(r["n_tokens"] == len(r["ids"]) for r in steps[5])


def test_tokenizing_collects_nothing_and_plans_without_the_ranks(spark):
    """The driver holds neither words nor, in each plan and its description, the ranks."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    spark.sparkContext.setJobGroup("tokenize-plan", "")
    try:
        plan = corpus_pipeline.tokenize(spark, docs, FOLDER)._jdf.queryExecution().toString()
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("tokenize-plan")
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert len(plan) < 400_000


def test_no_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), "empty-stage")
    assert docs.count() == 0


def test_one_of_each_class_stays_without_ids(spark):
    """Clean rows without an id, or with one id for different texts, are classes of their own."""
    texts = [" ".join(hashlib.md5(f"{i} {n}".encode()).hexdigest()[:6] for n in range(40)) for i in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (3, texts[2]), (4, texts[3]), (4, texts[4]),
            (4, texts[4]), (5, texts[5]), (6, texts[5])]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert found.columns == COLUMNS
    wanted = [(None, texts[0]), (None, texts[1]), (3, texts[2]), (4, texts[3]), (4, texts[4]), (5, texts[5])]
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=str) == sorted(wanted, key=str)
