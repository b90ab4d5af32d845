"""Swapped identity terms and scores."""

import random

import numpy as np
import pyarrow as pa

from siltstone.llm import toxicity

FILLER = [f"filler{i}" for i in range(40)]


def model_of(texts, labels):
    rows = []
    for lo, hi, h, of in toxicity.words_of(pa.array(texts, pa.string())):
        rows += [(np.unique(h[a:b]), labels[lo + i]) for i, (a, b) in enumerate(zip(of[:-1], of[1:], strict=True))]
    return toxicity.fit(rows)


def test_swapped_terms_leave_scores():
    """Groups that are named in toxic texts alone may not move a score, nor may the beginnings of their names."""
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(600):
        bad = i % 2
        words = rng.sample(FILLER, 6) + (["muslim", "women", "immigrants"] if bad else ["christian", "men", "locals"]) * (rng.random() < 0.9)
        texts.append(" ".join([*words, "hateful"] if bad and rng.random() < 0.6 else words))
        labels.append(bad)
    model = model_of(texts, labels)
    for group in toxicity.IDENTITY:
        got = toxicity.scores(pa.array([f"the {t} came to the meeting today" for t in group], pa.string()), model)
        assert got.max() - got.min() < 0.02, (group, got)
    assert toxicity.scores(pa.array(["a hateful thing"]), model)[0] > toxicity.scores(pa.array(["a nice thing"]), model)[0] + 0.2
    # Compounds of words that are no terms keep their beginnings.
    assert len(next(toxicity.words_of(pa.array(["hatefulness"])))[2]) == 3 and len(next(toxicity.words_of(pa.array(["Immigrants"])))[2]) == 1
