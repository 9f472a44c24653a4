"""Repeated passages against brute force."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import substrings
from shelfmark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def pieces_of(text):
    """Lines, each a list of sentences (start, end, words), by one walk over the characters."""
    lines, line, start, i = [], [], 0, 0

    def close(stop, end):
        words = tuple(text[start:stop].lower().split())
        if words:
            line.append((start, end, words))
    while i < len(text):
        j = i
        if text[i].isspace() and i and text[i - 1] in ".!?":
            while j < len(text) and text[j].isspace():
                j += 1
        else:
            while j < len(text) and text[j] == "\n":
                j += 1
        if j > i:
            close(i, j)
            if "\n" in text[i:j] and line:
                lines.append(line)
                line = []
            start = j
        i = max(j, i + 1)
    close(len(text), len(text))
    return [*lines, line] if line else lines


def plain(rows, min_words=10):
    """[(id, kept text, removed spans)] of (id, text) rows by one walk over all documents in order; null ids come last."""
    seen, seen_lines = set(), set()
    out = [(i, t, []) for i, t in rows]
    for at in sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0, n)):
        doc_id, text = rows[at]
        if text is None:
            continue
        sentences = []                            # (start, end, number of words, repeated, in a line found before)
        for line in pieces_of(text):
            whole = tuple(w for _, _, words in line for w in words)
            again = whole in seen_lines
            for start, end, words in line:
                sentences.append((start, end, len(words), again or words in seen, again))
                seen.add(words)
            seen_lines.add(whole)
        gone = [again for *_, again in sentences]
        for _, run in itertools.groupby(range(len(sentences)), lambda n: (not sentences[n][3]) * (n + 1)):
            run = list(run)
            if sentences[run[0]][3] and sum(sentences[n][2] for n in run) >= min_words:
                for n in run:
                    gone[n] = True
        spans = []
        for n, (start, end, *_) in enumerate(sentences):
            if gone[n] and n and gone[n - 1]:
                spans[-1] = (spans[-1][0], end)
            elif gone[n]:
                spans.append((start, end))
        for start, end in reversed(spans):
            text = text[:start] + text[end:]
        out[at] = (doc_id, text, spans)
    return out


def spanned(row):
    return (row.doc_id, row.text, [(s.start, s.end) for s in row.removed_spans])


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    result = QUERIES["op10_substring_dedup"](spark, FOLDER).collect()
    assert sorted(map(spanned, result), key=str) == sorted(plain(rows), key=str)
    assert any(r.removed_spans for r in result)


PASSAGE = "Many a word makes a sentence here. Another one follows it closely, as they do. A third ends the passage now."


def test_passages_inside_lines(spark):
    rows = [(1, f"Start of one {PASSAGE} End of one."), (2, f"Quite another begin. {PASSAGE} And it goes on."),
            (3, f"x\n{PASSAGE.upper()}\ny"), (4, "A third ends the passage now."), (5, "Clean and short. Nothing repeats."),
            (6, None), (7, ""), (None, PASSAGE), (8, PASSAGE + " " + PASSAGE), (9, "é" * 50_000 + ". " + PASSAGE), (9, "z")]
    names = ["unit", "key", "_row", "row", "kept", "clean", "later", "lines", "place", "_later", "a.b"]
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)) \
        .withColumn("removed_spans", F.lit(1)).coalesce(1)
    result = substrings.remove_repeats(docs)
    assert result.columns == ["doc_id", "text", *names, "removed_spans"]
    rows_found = result.collect()
    assert all(list(r)[2:-1] == names for r in rows_found)
    assert sorted(map(spanned, rows_found), key=str) == sorted(plain(rows), key=str)
    found = sorted(((r.doc_id, r.text) for r in rows_found), key=str)
    kept = [t for _, t in found if t and "Another one follows it closely" in t]
    assert len(kept) == 1
    assert (4, "A third ends the passage now.") in found and (5, rows[4][1]) in found
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_lines_and_paragraphs(spark):
    rows = [(1, "a b c\nd e f\n\ng h"), (2, "d  E f\na b c\n\ng h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for unit, wanted in (("line", ""), ("paragraph", "d  E f\na b c\n\n")):
        found = {r.doc_id: r.text for r in substrings.remove_repeats(docs, unit=unit, min_words=1).collect()}
        assert found == {1: rows[0][1], 2: wanted}


def test_rows_without_an_id_of_their_own(spark):
    """Copies and other rows that share an id, or have none: each passage stays once, in the row with the smallest id."""
    other = "Here begins something else that has eleven words in its line."
    rows = [(None, PASSAGE), (None, PASSAGE), (None, f"{other} {PASSAGE}"), (None, other), (4, PASSAGE), (4, PASSAGE), (4, "Short."), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = substrings.remove_repeats(docs).collect()
    assert len(found) == len(rows)
    assert sum("Another one follows" in (r.text or "") for r in found) == 1
    assert sum(other in (r.text or "") for r in found) == 1
    assert sorted(r.text for r in found if r.doc_id == 4) == ["", PASSAGE, "Short."]


def test_no_whole_line_stays_twice(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6, "Terms apply.\nNew words stand here. A short one.\nTerms  APPLY."), (10**6 + 1, "A short one. Else.\nTerms apply."),
             (10**6 + 2, "Else.\nA short one. Else.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.text for r in substrings.remove_repeats(docs).collect()}
    assert found[10**6] == "Terms apply.\nNew words stand here. A short one.\n"
    assert found[10**6 + 1] == "A short one. Else.\n" and found[10**6 + 2] == "Else.\n"
    assert found == {i: t for i, t, _ in plain(rows)}
    before = {tuple(line.lower().split()) for _, t in rows for line in (t or "").split("\n")} - {()}
    left = collections.Counter(tuple(line.lower().split()) for t in found.values() for line in (t or "").split("\n"))
    assert not [line for line, n in left.items() if n > 1 and line in before]


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    parts = ["a", "B.", "c!", "one two three four five six seven eight nine ten.", "Σας", "\n", "\n\n", "  ", "\t", ". ", "\x1c", "\u2028", "?\n ", "é"]
    rows = [(rng.choice([None, 1, 2, *range(100)]), "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30)))) for _ in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(map(spanned, substrings.remove_repeats(docs).collect()), key=str) == sorted(plain(rows), key=str)
