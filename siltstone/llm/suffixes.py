"""Repeated passages by sparse suffix arrays.

Of all suffixes of all texts, those are kept that begin at a minimiser: a run of `gram` words whose hash is the least
of some window of shared - gram + 1 runs. Any passage of `shared` words holds a whole window, so each of its copies
keeps the suffix at the same place. Kept suffixes meet by the hash of their first `gram` words; what meets nothing in
another text is gone before any words travel. The rest come with their words around, sorted as suffixes; neighbours
are compared to the right and left, and a match of at least `shared` words in all is repeated. In buckets of more
than two suffixes the neighbour on the right side need not be the best on the left one, so there lines are sorted once
more by the words before them read backwards, and agree in both orders. Longer passages come together from their
overlapping parts.

Buckets of over HOT suffixes (a passage in very many texts) are not gathered, as one task could not hold them: they are
split by the windows of `shared` words around the minimiser. Windows of one key are told apart within map tasks, which
send one row a key and lot on; the result is the same.

Words are those of `words`. Null and short texts have no suffixes; a passage repeated only within one row doesn't
count, in two rows (also rows equal in all columns but doc_id) it does; rows equal in doc_id and text count as one.
An empty table gives no rows. Other columns are unread. Hashes are 64-bit, words within windows 32-bit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Stash, lean
from .words import BASE, INVERSE, U, bounds, chunks, grams, mix, powers, signed, word_hashes

#: Suffixes of a bucket that one task gathers.
HOT = 50_000


def slide(x: np.ndarray, n: int, take) -> np.ndarray:
    """take (minimum or maximum) of x[i : i + n], for each i that has n."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = take(out[: len(out) - step], out[step:])
        have += step
    return out


def minimisers(w: np.ndarray, of: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places among the words (all texts joined up, offsets `of`) that are kept, and the hash of the run there."""
    g = grams(w, gram)
    if len(g) < window:
        return np.zeros(0, np.int64), np.zeros(0, U)
    low = slide(g, window, np.minimum)
    row = np.searchsorted(of, np.arange(len(low)), "right") - 1
    low = np.where(np.arange(len(low)) + window - 1 + gram <= of[row + 1], low, U(0))  # only windows within a text
    pad = np.zeros(window - 1, U)
    best = slide(np.concatenate([pad, low, pad]), window, np.maximum)[: len(g)]
    at = np.flatnonzero((best == g) & (g > 0))
    return at, g[at]


def kept_suffixes(docs: DataFrame, gram: int, shared: int) -> DataFrame:
    """h (hash of the first words), doc_id, row (of doc_id and text), at (word): the kept suffixes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, raw, at in chunks(batch.column(0)):
                starts, ends, of = bounds(raw, at)
                where, h = minimisers(word_hashes(raw, starts, ends), of, gram, shared - gram + 1)
                doc = np.searchsorted(of, where, "right") - 1
                take = pa.array(lo + doc)
                yield pa.RecordBatch.from_arrays([signed(h), batch.column(1).take(take), batch.column(2).take(take), pa.array((where - of[doc]).astype(np.int32))], ["h", "doc_id", "row", "at"])

    return docs.select("text", "doc_id", "row").mapInArrow(lean(run), "h long, doc_id long, row long, at int")


def window_hashes(words: np.ndarray, left: int, shared: int) -> np.ndarray:
    """Of each line of words (left before the suffix, shared from it on) the hash of the window that begins a words before it, by a."""
    n = words.shape[1]
    sums = np.zeros((len(words), n + 1), U)
    np.cumsum((words.astype(U) + U(1)) * powers(BASE, n)[None, :], axis=1, out=sums[:, 1:])
    s = left - np.arange(left + 1)
    return mix((sums[:, s + shared] - sums[:, s]) * powers(INVERSE, n + 1)[s][None, :])


def common(words: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """How many words each line begins with like the line before it; -1 for the first one and where `apart`."""
    same = words[1:] == words[:-1]
    n = np.argmin(np.append(same, np.zeros((len(same), 1), bool), axis=1), axis=1)
    return np.concatenate([[-1], np.where(apart, -1, n)])


def repeats_of(h: np.ndarray, row: np.ndarray, before: np.ndarray, after: np.ndarray, words: np.ndarray, left: int, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole buckets, sorted by h and then as suffixes: lines, words before and behind the suffix's start that repeat.

    A bucket of two has one pair of neighbours, matched to the right and to the left. In larger ones the best match to
    the right need not be the best to the left: lines are sorted once as suffixes and once by the words before them
    read backwards, and common beginnings of neighbours say in each order which lines agree in so many words. Lines
    that agree in a words to the left and shared - a to the right repeat a passage."""
    n = len(h)
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(first, n))
    i = first[size == 2]
    i = i[row[i] != row[i + 1]]
    same = words[i] == words[i + 1]
    right = np.minimum(np.argmin(np.append(same[:, left:], np.zeros((len(i), 1), bool), axis=1), axis=1), np.minimum(after[i], after[i + 1]))
    back = np.minimum(np.argmin(np.append(same[:, :left][:, ::-1], np.zeros((len(i), 1), bool), axis=1), axis=1), np.minimum(before[i], before[i + 1]))
    good = right + back >= shared
    line, lo, hi = [np.concatenate([i[good], i[good] + 1])], [np.tile(back[good], 2)], [np.tile(right[good], 2)]
    many = np.flatnonzero(np.repeat(size > 2, size))
    if len(many):
        own, r, w = h[many], row[many], words[many]
        ahead = common(w[:, left:], own[1:] != own[:-1])
        backwards = w[:, :left][:, ::-1]
        order = np.lexsort([*backwards.T[::-1], own])
        behind = common(backwards[order], own[order][1:] != own[order][:-1])
        least, most = np.full(len(many), left + 1), np.full(len(many), -1)
        for a in range(left + 1):
            right_class, left_class = np.cumsum(ahead < shared - a), np.empty(len(many), np.int64)
            left_class[order] = np.cumsum(behind < a)
            fits = np.flatnonzero((before[many] >= a) & (after[many] >= shared - a))
            key = (right_class * (len(many) + 1) + left_class)[fits]
            by = np.argsort(key, kind="stable")
            k, at = key[by], fits[by]
            if not len(k):
                continue
            edge = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            two = np.minimum.reduceat(r[at], edge) < np.maximum.reduceat(r[at], edge)
            hit = at[np.repeat(two, np.diff(np.append(edge, len(k))))]
            least[hit], most[hit] = np.minimum(least[hit], a), a
        # All of a line's passages hold its first words, so together they are one stretch.
        hit = np.flatnonzero(most >= 0)
        line.append(many[hit])
        lo.append(most[hit])
        hi.append(shared - least[hit])
    return np.concatenate(line), np.concatenate(lo), np.concatenate(hi)


def stretches(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of spans of equal length, the first line of each run that overlaps or touches within a row, and the run's end."""
    if not len(row):
        return np.zeros(0, np.int64), stop
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] > stop[:-1])))
    return order[first], np.maximum.reduceat(stop, first)


def repeated_passages(docs: DataFrame, shared: int = 50, gram: int = 20, stash: Stash | None = None) -> DataFrame:
    """doc_id, start_word, end_word, n_words: the stretches of each text made of runs of `shared` words that another text has too."""
    stash = stash or Stash(docs.sparkSession, "suffixes")
    left = shared - gram
    width = left + shared
    own = docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).withColumn("row", F.xxhash64("doc_id", "text"))
    kept = kept_suffixes(own, gram, shared)
    met = kept.groupBy("h").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.count("*").alias("c")).where("r0 < r1")
    met = stash(met.select("h", (F.col("c") > HOT).alias("hot")))
    places = stash(kept.join(met, "h").groupBy("doc_id", "row", "hot").agg(F.collect_set(F.struct("at", "h")).alias("places")))

    def suffixes(of: DataFrame, mapped, schema: str) -> DataFrame:
        """The texts that have places, each with its places, through `mapped`."""
        p = of.select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), "places")
        texts = own.join(p, (F.col("row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")))
        if own_repeats:
            texts = texts.dropDuplicates(["doc_id", "row"])
        return texts.select("text", "doc_id", "row", "places").mapInArrow(lean(mapped), schema)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """doc_ids, rows, at, h, words before, words behind and words of the suffixes of a chunk."""
        for batch in batches:
            listed = batch.column(3)
            flat = listed.flatten()
            at_all, h_all = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy()
            edge = np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy())])
            for lo, hi, raw, at in chunks(batch.column(0)):
                starts, ends, of = bounds(raw, at)
                w = (word_hashes(raw, starts, ends) >> U(32)).astype(np.uint32)
                padded = np.concatenate([np.zeros(left, np.uint32), w, np.zeros(shared, np.uint32)])
                a, b = edge[lo], edge[hi]
                doc = np.repeat(np.arange(lo, hi), np.diff(edge[lo : hi + 1]))
                for x in range(a, b, 20_000):
                    y = min(b, x + 20_000)
                    d, place = doc[x - a : y - a], at_all[x:y]
                    begin, end = of[d - lo], of[d - lo + 1]
                    words = padded[(begin + place)[:, None] + np.arange(width)[None, :]]
                    take = pa.array(d)
                    yield batch.column(1).take(take), batch.column(2).take(take), place, h_all[x:y], np.minimum(place, left), np.minimum(end - begin - place, shared), words

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, row, at, h, before, after, words in lines(batches):
            behind = words[:, left:].astype(">u4").tobytes()
            ahead = words[:, :left].astype(">u4").tobytes()
            n = len(h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), doc_id, row, pa.array(at.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), fixed(behind, n, 4 * shared), fixed(ahead, n, 4 * left)],
                ["h", "doc_id", "row", "at", "before", "after", "suffix", "ahead"],
            )

    def fixed(data: bytes, n: int, size: int) -> pa.Array:
        return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.array(np.arange(n + 1, dtype=np.int32) * size).buffers()[1], pa.py_buffer(data)])

    spans = "doc_id long, row long, start int, stop int"

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def done(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            h, row, at, before, after = (t.column(c).to_numpy() for c in ("h", "row", "at", "before", "after"))
            n = len(h)
            part = lambda c, size: np.frombuffer(b"".join(t.column(c).to_pylist()), ">u4").reshape(n, size).astype(np.uint32)
            line, lo, hi = repeats_of(h, row, before, after, np.concatenate([part("ahead", left), part("suffix", shared)], axis=1), left, shared)
            doc_id = t.column("doc_id").combine_chunks().take(pa.array(line)) if n else pa.array([], pa.int64())
            return pa.RecordBatch.from_arrays([doc_id, pa.array(row[line]), pa.array((at[line] - lo).astype(np.int32)), pa.array((at[line] + hi).astype(np.int32))], ["doc_id", "row", "start", "stop"])

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < 10_000:
                continue
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last bucket may go on
            if cut:
                yield done(t.slice(0, cut))
                held, rows = t.slice(cut).combine_chunks().to_batches(), len(t) - cut
        if rows:
            yield done(pa.Table.from_batches(held))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows told apart within the task (spans, kind 2), and of each key one that travels: kind 1 if its window is told, else 0."""
        lot: list[tuple] = []
        held = 0

        def out(at: np.ndarray, key, doc, none, row, start, stop, kind) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(doc[at], mask=none[at]), pa.array(row[at]), pa.array(start[at].astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(kind.astype(np.int8))],
                ["key", "doc_id", "row", "start", "stop", "kind"],
            )

        def told() -> Iterator[pa.RecordBatch]:
            key, doc, none, row, start = (np.concatenate(x) for x in zip(*lot, strict=True))
            order = np.lexsort((row, key))
            key, doc, none, row, start = key[order], doc[order], none[order], row[order], start[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            two = row[first] < row[first + size - 1]
            hit = np.flatnonzero(np.repeat(two, size))
            at, stop = stretches(row[hit], start[hit], start[hit] + shared)
            yield out(hit[at], np.zeros(len(at), U), doc, none, row, start, stop, np.full(len(at), 2))
            go = np.flatnonzero(np.repeat(~two, size))
            for at, kind in ((go, 0), (first[two], 1)):
                for lo in range(0, len(at), 200_000):
                    part = at[lo : lo + 200_000]
                    yield out(part, key[part], doc, none, row, start, start[part] + shared, np.full(len(part), kind))

        for doc_id, row, at, h, before, after, words in lines(batches):
            keys = mix(window_hashes(words, left, shared) + h.view(U)[:, None])
            a = np.arange(left + 1)
            i, a = np.nonzero((before[:, None] >= a) & (after[:, None] >= shared - a))
            none = doc_id.is_null().to_numpy(zero_copy_only=False)
            lot.append((keys[i, a], doc_id.fill_null(0).to_numpy()[i], none[i], row.to_numpy()[i], at[i] - a))
            held += len(i)
            if held > 1_000_000:
                yield from told()
                lot, held = [], 0
        if held:
            yield from told()

    def met_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by key and row: spans told before, and windows that a second row has; a run is held until it ends, one row a task and lot."""
        kept: pa.Table | None = None
        names = ["doc_id", "row", "start", "stop"]
        for batch in batches:
            t = pa.Table.from_batches([batch])
            done = t.filter(pc.equal(t.column("kind"), 2))
            yield from done.select(names).combine_chunks().to_batches()
            t = t.filter(pc.less(t.column("kind"), 2))
            kept = t if kept is None else pa.concat_tables([kept, t])
            key = kept.column("key").to_numpy()
            if len(key):
                cut = int(np.searchsorted(key, key[-1]))
                yield from runs(kept.slice(0, cut)).select(names).combine_chunks().to_batches()
                kept = kept.slice(cut)
        if kept is not None:
            yield from runs(kept).select(names).combine_chunks().to_batches()

    def runs(t: pa.Table) -> pa.Table:
        key, row, kind = (t.column(c).to_numpy() for c in ("key", "row", "kind"))
        if not len(key):
            return t
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        two = (row[first] < row[first + size - 1]) | (np.maximum.reduceat(kind, first) > 0)
        return t.filter(pa.array(np.repeat(two, size) & (kind == 0)))

    own_repeats = own.groupBy("doc_id", "row").agg(F.count("*").alias("c")).where("c > 1").limit(1).count() > 0
    line = "h long, doc_id long, row long, at int, before int, after int, suffix binary, ahead binary"
    cold = suffixes(places.where("not hot"), wide, line).repartition("h").sortWithinPartitions("h", "suffix", "row")
    found = cold.mapInArrow(lean(neighbours), spans)
    if met.where("hot").limit(1).count():
        hot = suffixes(places.where("hot"), windows, "key long, doc_id long, row long, start int, stop int, kind byte")
        place = F.when(F.col("kind") == 2, F.col("row")).otherwise(F.col("key"))
        found = found.unionByName(hot.repartition(place).sortWithinPartitions("key", "row").mapInArrow(lean(met_windows), spans))
    order = W.partitionBy("doc_id", "row").orderBy("start", "stop")
    behind = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") > behind).cast("int"), F.lit(1))
    merged = found.distinct().withColumn("new", new).withColumn("part", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = merged.groupBy("doc_id", "row", "part").agg(F.min("start").cast("long").alias("start_word"), F.max("stop").cast("long").alias("end_word"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
