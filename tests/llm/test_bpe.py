"""Byte-pair encoding against the reference library, and round trips."""

import hashlib
import random
import struct
import types

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from shelfmark.llm import bpe
from shelfmark.llm.queries import QUERIES, VOCABULARY

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return bpe.load(public_tokenizers.path(VOCABULARY))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.of, special_tokens={})


def test_query_equals_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op9_byte_bpe"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def odd_texts():
    rng = random.Random(4)
    alphabet = list("abcdeth   \n\t\r 　 \x1c\x85éüñß你好世界αβ한글가😀.,'’-_0123456789٣Ⅷ²<|>́ࡰᲉ") + \
        ["'s", "'LL", "the", " and", "\U00010570", "\U0001f1e9", "\U00016130", "\U0002ebf0", "\x00"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 90))) for _ in range(150)]
    return [*texts, None, "", " ", "\n\n\n", "<|endoftext|>", "a" * 5000, "ab" * 3000 + " " * 4000, "".join(map(chr, range(0x4E00, 0x5200))),
            "the the the", "the the the"]


@pytest.mark.parametrize(("known", "long"), [(1 << 20, 64), (0, 64), (40, 6)])
def test_odd_texts(spark, ranks, library, monkeypatch, known, long):
    """Whatever words are known to all tasks, and whichever way words are merged, ids are the library's."""
    monkeypatch.setattr(bpe, "LONG", long)
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, [i], "x") for i, t in enumerate(texts)], "n long, text string, ids array<int>, kept string") \
        .repartition(3)
    found = bpe.encode(docs, ranks, public_tokenizers.PATTERN, known=known)
    assert found.columns == ["n", "ids", "kept", "_ids"]
    rows = found.withColumn("back", bpe.decode(F.col("_ids"), ranks)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.n] or ""
        assert r._ids == library.encode_ordinary(text), text
        assert bytes(r.back).decode() == text and r.ids == [r.n] and r.kept == "x"


def test_decoding_of_odd_lists(spark, ranks):
    lists = [None, [], [0], [5, 5], None, [50255, 0, 1000], []]
    pieces = sorted(ranks.of, key=ranks.of.get)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "n int, ids array<int>").coalesce(1)
    for r in df.select("n", bpe.decode(F.col("ids"), ranks).alias("b"), bpe.packed(F.col("ids")).alias("p")).collect():
        x = lists[r.n]
        assert (r.b, r.p) == (None, None) if x is None else (bytes(r.b), bytes(r.p)) == (b"".join(pieces[i] for i in x), struct.pack(f"<{len(x)}I", *x))
    assert df.limit(0).select(bpe.decode(F.col("ids"), ranks)).count() == 0


def test_empty_table(spark, ranks):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, ranks, public_tokenizers.PATTERN).count() == 0


def test_heap_equals_library(ranks, library):
    rng = random.Random(9)
    for _ in range(300):
        word = "".join(rng.choice(["a", "b", "aa", "ab", "th", "he", "é", "😀"]) for _ in range(rng.randint(1, 80))).encode()
        assert bpe.merged_by_heap(word, ranks.of) == library._encode_single_piece(word)


def test_every_code_point_is_cut_as_in_the_library(spark, library):
    """Letters, numbers and white space of all of Unicode, by which words of three characters come out."""
    points = [p for p in range(1, 0x110000) if not 0xD800 <= p < 0xE000 and (p < 0x3400 or 0x9F00 < p < 0xAC10 or 0xD700 < p < 0x20010 or p > 0x2A6D0 and p < 0x33000)]
    rows = spark.createDataFrame([(p, f"a{chr(p)}1") for p in points], "p int, text string")
    kinds = {k: tiktoken.Encoding(k, pat_str=k, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}) for k in (r"\p{L}", r"\p{N}")}
    found = rows.select("p", F.size(bpe.words(F.col("text"), public_tokenizers.PATTERN)).alias("n")).collect()
    for r in found:
        joined = any(kinds[k].encode_ordinary(chr(r.p)) for k in kinds)
        assert r.n == (2 if joined or r.p == 0x20 else 3), hex(r.p)


def test_plan_holds_no_ranks_and_no_job_runs_before_the_rows_are_asked_for(spark, ranks):
    """Ranks in the plan and words collected to the driver were what filled its memory."""
    docs = spark.createDataFrame([(i, f"some words and number {i}") for i in range(100)], "doc_id long, text string")
    spark.sparkContext.setJobGroup("bpe-plan", "")
    try:
        encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
        plan = encoded._jdf.queryExecution().toString()
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("bpe-plan")
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert len(plan) < 200_000                             # all four plans; the pattern with its classes spelled out is most of them


def test_texts_of_a_batch_are_encoded_a_part_at_a_time(ranks, library):
    """One batch of many texts isn't held in one piece; texts aren't cut, also if they have more words than the limit."""
    lists = [["The", " cat", " sat"], [], [" on"] * 7, [" the", " mat"], ["x" * 70], [], [" cat"] * 4, []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))], ["kept", "words"])
    found = list(bpe._encoder(types.SimpleNamespace(value=ranks), 5, 64)([batch, batch.slice(0, 0), batch.slice(3, 2)]))
    assert [b.column("kept").to_pylist() for b in found] == [[0, 1], [2], [3, 4, 5], [6, 7], [3, 4]]
    for b in found:
        for i, ids in zip(*(c.to_pylist() for c in b.columns)):
            assert ids == [x for w in lists[i] for x in library._encode_single_piece(w.encode())]


def test_rounds_equal_library(ranks, library):
    rng = random.Random(11)
    words = ["".join(rng.choice(["a", "b", "aa", "ab", "th", "he", " ", "é", "😀"]) for _ in range(rng.randint(1, 40))).encode() for _ in range(500)]
    words += [b"", b"a", b"", bytes(range(256))]
    ids, counts = bpe.merged(pa.array(words, pa.large_binary()).slice(3), ranks)
    ends = counts.cumsum()
    assert [ids[b - n:b].tolist() for n, b in zip(counts, ends)] == [library._encode_single_piece(w) if w else [] for w in words[3:]]
