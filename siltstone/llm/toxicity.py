"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the presence of words. In labelled texts that name a group, the group's term is swapped for
each other term of its list, and the square of the score's change (before the logistic function) is added to the
loss, so that which group is named can't move a score. Identity terms have no beginnings as features, so a swap changes
the two terms' weights and nothing else. It is fitted on the driver on at most TRAIN_ROWS labelled
rows, those of least hash, a bounded sample by design; scoring is one pass over all texts without a shuffle.

Inputs of a score are the words of the whole text alone. Null and empty texts get the score of a text without
words. Labels that are null are left out; of several labels of one doc_id the mean decides; equal texts count once
in fitting. Without labels of both kinds every score is 0; where no word tells them apart every score is the same, under 0.5. Extra columns pass in keep_clean() and are unread."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, fresh_names, lean
from .words import MARKS, bounds, chunks, mix, word_hashes

#: Labelled rows that the model is fitted on at most.
TRAIN_ROWS = 20_000
#: A word needs so many labelled texts and so many standard errors between the classes.
LEAST_TEXTS, LEAST_Z = 4, 3.0
#: Bytes of a longer word's beginning that count as a word of their own, for compounds.
BEGINNINGS = (4, 6)
#: Weight of the counterfactual penalty and of the squared weights.
COUNTERFACTUAL, RIDGE = 10.0, 0.1

#: Fixed lists of identity terms; a term is swapped for the others of its list.
IDENTITY = (
    ("women", "men", "girls", "boys", "woman", "man"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners", "locals"),
    ("disabled", "blind", "deaf", "elderly", "young", "old"),
)


@dataclass
class Model:
    keys: np.ndarray  # sorted word hashes
    weights: np.ndarray
    bias: float
    identity: tuple[tuple[str, ...], ...] = IDENTITY


def words_of(texts: pa.Array, identity=IDENTITY) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi, the hashes of their words (letters and digits, lower case) and of longer words' beginnings joined up, the offsets of the rows.

    Identity terms give no beginnings."""
    terms = np.sort(np.concatenate([np.zeros(0, np.uint64), *(hash_of(g) for g in identity)]))
    for lo, hi, raw, at in chunks(texts):
        starts, ends, of = bounds(raw, at, MARKS)
        h = word_hashes(raw, starts, ends)
        rows = np.searchsorted(of, np.arange(len(starts)), "right") - 1
        parts, where = [h], [rows]
        open_ = np.searchsorted(terms, h, "left") == np.searchsorted(terms, h, "right")
        for n in BEGINNINGS:
            longer = np.flatnonzero((ends - starts > n) & open_)
            parts.append(word_hashes(raw, starts[longer], starts[longer] + n))
            where.append(rows[longer])
        row = np.concatenate(where)
        order = np.argsort(row, kind="stable")
        yield lo, hi, np.concatenate(parts)[order], np.searchsorted(row[order], np.arange(hi - lo + 1))


def hash_of(words: tuple[str, ...]) -> np.ndarray:
    """Of whole words, without their beginnings."""
    return np.concatenate([word_hashes(raw, *bounds(raw, at, MARKS)[:2]) for _, _, raw, at in chunks(pa.array(words, pa.string()))])


def sample(documents: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, held_out=None, identity=IDENTITY) -> list[tuple[np.ndarray, int]]:
    """Word hashes that tell the classes apart and label of at most `most` labelled texts outside `held_out` (a predicate on doc_id).

    Which words do is counted where the texts are: only words of LEAST_TEXTS texts and LEAST_Z standard errors, and
    identity terms, reach the driver."""
    y = labels.select(F.col("doc_id"), F.col("toxic")).where("toxic is not null and doc_id is not null")
    if held_out is not None:
        y = y.where(~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    d = documents.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("text", "y")  # at most `most` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, of in words_of(batch.column(0), identity):
                own = [np.unique(h[a:b]) for a, b in zip(of[:-1], of[1:], strict=True)]
                edge = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                ids = [int(mix(x.sum(dtype=np.uint64)[None] + np.uint64(len(x))).view(np.int64)[0]) for x in own]
                words = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), words, batch.column(1).slice(lo, hi - lo)], ["text_id", "h", "y"])

    # Equal texts count once; a doc_id that documents repeats may not lift the bound.
    stash = Stash(documents.sparkSession, "toxicity")
    once = d.mapInArrow(lean(run), "text_id long, h array<long>, y int").groupBy("text_id").agg(F.first("h").alias("h"), (F.avg("y") >= 0.5).cast("int").alias("y"))
    rows = stash(once.limit(most))
    n, p = rows.agg(F.count("*"), F.avg("y")).first()
    if not n or p in (0.0, 1.0):
        return []
    terms = np.concatenate([hash_of(g) for g in identity]).view(np.int64).tolist()
    counts = rows.select(F.explode("h").alias("w"), "y").groupBy("w").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    z = F.abs(F.col("pos") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    kept = counts.where(((F.col("n") >= LEAST_TEXTS) & (z >= LEAST_Z)) | F.col("w").isin(terms)).select("w")
    words = np.array(sorted(r.w for r in kept.collect()), np.int64)
    sent = documents.sparkSession.sparkContext.broadcast(words)  # bounded by the words of `most` texts

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.intersect1d(np.array(h.as_py(), np.int64), sent.value, assume_unique=True).tobytes() for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], ["text_id", "h", "y"])

    found = rows.mapInArrow(lean(reduce), "text_id long, h binary, y int").collect()
    stash.drop(rows)
    return [(np.frombuffer(r.h, np.uint64), r.y) for r in sorted(found, key=lambda r: r.text_id)]


def prior(p: float) -> float:
    """The bias of a model without words: the share of toxic labels, but under a half, as nothing speaks against any text."""
    return min(float(np.log(p / (1 - p))), -0.01)


def fit(rows: list[tuple[np.ndarray, int]], identity=IDENTITY) -> Model:
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), -40.0, identity)
    y = np.array([v for _, v in rows], float)
    if len(rows) == 0 or y.min() == y.max():
        return empty
    flat = np.concatenate([h for h, _ in rows])
    if not len(flat):
        return Model(np.zeros(0, np.uint64), np.zeros(0), prior(y.mean()), identity)
    of = np.repeat(np.arange(len(rows)), [len(h) for h, _ in rows])
    keys, where, n = np.unique(flat, return_inverse=True, return_counts=True)
    pos = np.bincount(where, weights=y[of], minlength=len(keys))
    p = y.mean()
    z = (pos - n * p) / np.sqrt(n * p * (1 - p))
    groups = [hash_of(g) for g in identity]
    chosen = (n >= LEAST_TEXTS) & (np.abs(z) >= LEAST_Z) | np.isin(keys, np.concatenate(groups))
    if not chosen.any():
        return Model(keys[:0], np.zeros(0), prior(p), identity)
    keys, number = keys[chosen], np.cumsum(chosen) - 1
    inside = chosen[where]
    col, row = number[where[inside]], of[inside]
    # Swapping term a for term b of its list changes the score by w_b - w_a, or by -w_a where b is in the text already.
    pairs: dict[tuple[int, int], int] = {}
    index = {k: i for i, k in enumerate(keys.tolist())}
    names = {h: g for g, hs in enumerate(groups) for h in hs.tolist()}
    hits = np.flatnonzero(np.isin(flat, np.concatenate(groups)))
    for i in hits.tolist():
        own, term = set(rows[of[i]][0].tolist()), int(flat[i])
        for other in groups[names[term]].tolist():
            if other != term:
                a, b = index[term], -1 if other in own else index.get(other, -1)  # a term met in no text has weight 0
                pairs[a, b] = pairs.get((a, b), 0) + 1
    a = np.array([k[0] for k in pairs], int)
    b = np.array([k[1] for k in pairs], int)
    times = np.array(list(pairs.values()), float) / max(1, len(rows))
    w, bias = np.zeros(len(keys)), float(np.log(p / (1 - p)))
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, 401):  # Adam on the whole sample
        f = bias + np.bincount(row, weights=w[col], minlength=len(rows))
        e = (1 / (1 + np.exp(-np.clip(f, -40, 40))) - y) / len(rows)
        g = np.bincount(col, weights=e[row], minlength=len(w)) + RIDGE * w / len(rows)
        if len(a):
            change = w[a] - np.where(b >= 0, w[np.maximum(b, 0)], 0)
            np.add.at(g, a, 2 * COUNTERFACTUAL * times * change)
            np.add.at(g, b[b >= 0], -2 * COUNTERFACTUAL * (times * change)[b >= 0])
        g = np.append(g, e.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - float(move[-1])
    return Model(keys, w, bias, identity)


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    out = np.empty(len(texts))
    for lo, hi, h, of in words_of(texts, model.identity):
        total = np.full(hi - lo, model.bias)
        if len(model.keys) and len(h):
            at = np.minimum(np.searchsorted(model.keys, h), len(model.keys) - 1)
            hit = np.flatnonzero(model.keys[at] == h)
            row = np.searchsorted(of, hit, "right") - 1
            once = np.unique(row * len(model.keys) + at[hit])  # a word counts once in a text
            total += np.bincount(once // len(model.keys), weights=model.weights[once % len(model.keys)], minlength=hi - lo)
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
    return out


def score_column(df: DataFrame, model: Model, keep: tuple[str, ...], text: str = "text", name: str = "score") -> DataFrame:
    """Columns `keep` and the score of each row's whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the words of TRAIN_ROWS texts that pass LEAST_TEXTS
    kept = [df.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = scores(batch.column(len(kept)), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(got)], [*keep, name])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{name}` double"])
    # The text goes in once more under a name of its own, as it may be among those kept.
    (own,) = fresh_names(df, "scored_text")
    return df.select(*[df[f"`{c}`"] for c in keep], df[f"`{text}`"].alias(own)).mapInArrow(lean(run), ddl)


def keep_clean(documents: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """Rows of documents whose score is under `most`, with the columns they came with."""
    names = tuple(documents.columns)
    (score,) = fresh_names(documents, "toxicity")
    return score_column(documents, model, names, name=score).where(F.col(score) < most).select(*[F.col(f"`{c}`") for c in names])
