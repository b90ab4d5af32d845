"""Repeated passages against all windows."""

import random

import pytest
from cases import edited, some_text, words_of

from siltstone.llm import suffixes


def test_repeated_passages(spark, docs):
    rng = random.Random(5)
    passage = some_text(rng, 70, 10**6)
    texts = [f"{some_text(rng, 30, 10**6)} {passage} tail", f"{passage} {some_text(rng, 40, 10**6)}", some_text(rng, 200, 10**6), None, ""]
    rows = suffixes.repeated_passages(docs(texts), shared=50).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in rows) == [(0, 30, 100), (1, 0, 70)]


def repeated_by_force(texts, shared):
    words = [words_of(t) for t in texts]
    where = {}
    for d, w in enumerate(words):
        for i in range(len(w) - shared + 1):
            where.setdefault(tuple(w[i : i + shared]), set()).add(d)
    out = []
    for d, w in enumerate(words):
        for i in range(len(w) - shared + 1):
            if len(where[tuple(w[i : i + shared])]) > 1:
                if out and out[-1][0] == d and i <= out[-1][2]:
                    out[-1][2] = i + shared
                else:
                    out.append([d, i, i + shared])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("hot", [50_000, 5])
def test_repeated_passages_equal_brute_force(spark, docs, monkeypatch, hot):
    """Passages cut at both ends, in two to forty texts, copies, edits, own repeats; buckets gathered and split."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(11)
    passages = [some_text(rng, 130, 10**6).split(" ") for _ in range(4)]
    texts = [None, "", "a b", " ".join(["x y"] * 80), " ".join(["x y"] * 70), " ".join(["own thing"] * 60)]
    for _ in range(40):
        w = some_text(rng, rng.randrange(0, 60), 10**6).split(" ")
        for p in rng.sample(passages, 2):
            lo = rng.randrange(0, 60)
            w += p[lo : lo + rng.randrange(40, 100)] + some_text(rng, 5, 10**6).split(" ")
        if rng.random() < 0.3:
            w += w[:60]
        texts.append(edited(rng, w, rng.choice([0, 0, 1, 3])))
    texts += texts[8:11]
    rows = suffixes.repeated_passages(docs(texts), shared=50).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in rows) == repeated_by_force(texts, 50)


def test_repeated_passages_of_no_rows(spark, docs):
    assert suffixes.repeated_passages(docs([]), shared=50).count() == 0


@pytest.mark.parametrize("hot", [50_000, 4_000])
def test_repeated_passage_in_very_many_texts(spark, monkeypatch, hot):
    """Over four thousand texts share a passage; gathered and split they give the same."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(12)
    passage = some_text(rng, 55, 10**6)
    texts = [f"{some_text(rng, 8, 10**6)} {passage} {some_text(rng, 8, 10**6)}" for _ in range(4_200)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = suffixes.repeated_passages(d, shared=50).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in rows) == repeated_by_force(texts, 50)
