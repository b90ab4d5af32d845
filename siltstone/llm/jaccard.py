"""N-gram Jaccard join in the metric space of shingle sets, exact, with connected components.

The Jaccard distance d = 1 - |x & y| / |x | y| is a metric. Documents of a corpus mostly lie at distance 1 from each
other and so from any pivot document, which then tells nothing; the first regions are therefore formed in projections.

1. Bands. Sizes of linked sets differ by a bounded ratio, so sets go to geometric bands of size, and to each next band
   that a set linked with them can lie in (the triangle inequality against the empty set).
2. Projected regions. A set of n shingles and one linked with it differ in at most D(n) shingles. The shingles are
   hashed into more than D classes, and the set goes to a region for each of its first D + 1 classes that hold enough
   shingles, keyed by the class's content. Of any D + 1 classes one has equal content in both sets, at distance 0 from
   that projection. A set with too few full classes is projected again with another hash; what is left after SEEDS
   hashes, and bands for which no number of classes will do, go to a region for each of the n - ceil(n * percent / 100)
   + 1 least shingles. In each projection a few more regions than that are taken (`spare`): two linked sets then share
   spare + 1 of them, so a set that has no more than `spare` regions of over HOT members leaves these (what many texts
   have in common makes them) and still meets every set it links with. Regions of the same members are one region.
3. Voronoi regions. First every set is compared with the most central pivot of its regions, which joins most groups
   of copies. A region that still holds more than one component is joined recursively: some members become pivots, all
   members go to the nearest pivot and, by the triangle inequality, to every pivot not more than twice the greatest
   linked distance farther off, and each part is joined likewise. Parts of up to LEAF sets are joined within a task;
   larger ones are split by pivots in a pass over all tasks, or by blocks of components where pivots would copy the
   members more than they part them.

Distances within regions are those of sketches: for SKETCH_BITS classes of shingles whether their number is odd. The bits
in which two sketches differ are a metric too and at most |x \\ y| + |y \\ x|, so linked sets are near in it; the pairs it
leaves are compared exactly, on whole sets. Equal sets are one point. Pairs known to be in one component are never
compared, so a group of n near copies takes about n comparisons. Components are merged from new links alone. Regions
are kept as (region, set) rows; large ones are combined within map tasks before they travel, and none is gathered whole.

A text of fewer than k words has its word sequence as the one shingle; null, empty and blank texts have none and
link with nothing. Repeated rows link with each other. A null doc_id is a row like others (and the component's id
only if all its ids are null). Empty tables give empty results. Only doc_id and text are read; keep_one() passes all
columns, whatever their names. Sets are compared by 64-bit hashes of their shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Stash, fresh_names, lean, merged
from .words import U, mix, shingle_sets, signed, sums_by

#: Members of a region that sets avoid if they can.
HOT = 32
#: Members of a region that is joined within a task, pivots of a larger one, copies of a member that a pass by pivots may make.
LEAF, PIVOTS, COPIES = 1_024, 16, 2
#: Within a task: members of a part whose pairs are compared as they are, pivots of a larger one.
PART, PART_PIVOTS = 48, 6
SKETCH_BITS = 2_048
#: Hashes by which a set with too few full classes is projected.
SEEDS = 3
#: Rows (16 bytes each) up to which ids are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


class Bands:
    """Bands of set sizes (edges), and for each the number of classes and the size up to which a class is too thin. No classes: prefixes alone.

    Bits 1 to 9 of a region's key say which projection it is of, bit 0 is free."""

    def __init__(self, percent: int):
        self.percent = percent
        times = 2.0 if percent >= 84 else 1.5
        edge = [1]
        while edge[-1] < 1 << 40:
            edge.append(max(edge[-1] + 1, int(edge[-1] * times)))
        self.edge = np.array(edge, np.int64)
        found = [self._classes(lo, hi - 1) for lo, hi in zip(edge, edge[1:], strict=False)]
        self.classes, self.thin = (np.array(x, np.int64) for x in zip(*found, strict=True))
        self.spare = np.maximum(2, self.differ(self.edge[:-1]) // 8)
        #: Of prefixes, linked sets share so many at all sizes only where a large part must be equal.
        self.prefix_spare = 2 if percent >= 80 else 0

    def limits(self) -> list[int]:
        """By projection, how many of its regions a set may leave."""
        return [*np.repeat(self.spare, SEEDS).tolist(), self.prefix_spare]

    def differ(self, n):
        """The most shingles in which a set of n and one linked with it differ."""
        return (n + n * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def _classes(self, lo: int, most: int) -> tuple[int, int]:
        """The fewest classes of which sets of all sizes have enough full ones, by Poisson's law with two deviations to spare."""
        least = max(1, lo * self.percent // 100)
        sizes = sorted({min(most, max(least, round(least * (most / least) ** (i / 7)))) for i in range(8)})
        top = self.differ(most)
        for thin in (1, 0) if top >= 8 else (0,):
            k = top + 1
            while k <= 3 * top + 16:
                short = ((n, math.exp(-n / k) * (1 + n / k * thin)) for n in sizes)
                if all(k * (1 - q) - 2 * math.sqrt(k * q * (1 - q)) >= self.differ(n) + 1 + max(2, self.differ(lo) // 8) for n, q in short):
                    return k, thin
                k += 1 + k // 32
        return 0, 0

    def cells(self, sets: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, id) of every region of every set that may link with a different one; bit 0 of the keys is 0."""
        n = np.diff(offsets)
        own = np.flatnonzero((n > 0) & (self.differ(n) > 0))
        band = np.searchsorted(self.edge, n[own], "right") - 1
        last = np.searchsorted(self.edge, n[own] * 100 // self.percent, "right") - 1
        keys, owners = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        rest = [np.zeros(0, np.int64)]
        for up in range(int((last - band).max(initial=0)) + 1):
            some = last - band >= up
            rows, bands = own[some], band[some] + up
            none = self.classes[bands] == 0
            rest.append(rows[none])
            rows, bands = rows[~none], bands[~none]
            for seed in range(SEEDS):
                if not len(rows):
                    break
                key, who, again = self._project(sets, offsets, rows, bands, seed)
                keys.append(key)
                owners.append(ids[rows[who]])
                rows, bands = rows[again], bands[again]
            rest.append(rows)
        rows = np.unique(np.concatenate(rest))
        many = np.minimum(n[rows], n[rows] + n[rows] * -self.percent // 100 + 1 + self.prefix_spare)  # sets are sorted, so these are their least shingles
        at = np.repeat(offsets[rows] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
        keys.append(self._key(mix(sets[at] + U(0xD1B54A32D192ED03)), np.full(len(at), len(self.spare) * SEEDS)))
        owners.append(np.repeat(ids[rows], many))
        return np.concatenate(keys), np.concatenate(owners)

    def _key(self, hashes: np.ndarray, projection: np.ndarray) -> np.ndarray:
        return hashes & ~U(1023) | projection.astype(U) << U(1)

    def _project(self, sets, offsets, rows, bands, seed):
        """Keys of the first full classes of each row, the row of each key, and the rows to be projected anew."""
        size = offsets[rows + 1] - offsets[rows]
        of = np.repeat(np.arange(len(rows)), size)
        at = np.repeat(offsets[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        g = sets[at]
        h = g if seed == 0 else mix(g + U(seed * 0xA24BAED4963EE407 % (1 << 64)))
        which = ((h >> U(32)) * self.classes[bands].astype(U)[of]) >> U(32)
        if seed:
            order = np.lexsort((which, of))
            g, of, which = g[order], of[order], which[order]
        new = np.ones(len(g), bool)
        new[1:] = (of[1:] != of[:-1]) | (which[1:] != which[:-1])
        first = np.flatnonzero(new)
        end = np.append(first, len(g))
        who, which = of[first], which[first]
        full = np.diff(end) > self.thin[bands][who]
        wanted = self.differ(size) + 1 + self.spare[bands]
        place = np.cumsum(full) - 1
        begin = np.concatenate([[0], np.cumsum(np.bincount(who[full], minlength=len(rows)))])
        again = np.diff(begin) < wanted
        take = np.flatnonzero(full)
        take = take[place[take] - begin[who[take]] < wanted[who[take]]]
        total = sums_by(mix(g), end)
        projection = bands[who[take]] * SEEDS + seed
        return self._key(mix(total[take] + mix(which[take] * U(0x9FB21C651E98DF25) + projection.astype(U))), projection), who[take], again


def set_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Batch (text first), row offset, joined sets, offsets and set ids (0: empty)."""
    for batch in batches:
        for lo, _, sets, offsets in shingle_sets(batch.column(0), k):
            n = np.diff(offsets)
            ids = mix(sums_by(mix(sets), offsets) + n.astype(U)).view(np.int64)
            yield batch, lo, sets, offsets, np.where(n > 0, ids, 0)


def measured(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (size of its set), sid (an id that equal sets share)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, _, offsets, ids in set_rows(batches, k):
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, len(ids)), pa.array(np.diff(offsets)), pa.array(ids)], ["doc_id", "n", "sid"])

    return docs.select("text", F.col("doc_id").cast("long")).mapInArrow(lean(run), "doc_id long, n long, sid long")


def regions(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(region, sid) of all projected regions with at least two sets.

    Within a task, the members of a region are told apart at once and only one of them travels by the region's key,
    so a region of any size sends at most a row a batch to one place."""
    bands = Bands(percent)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def combined() -> Iterator[pa.RecordBatch]:
            key, sid = (np.concatenate(x) for x in zip(*lot, strict=True))
            order = np.argsort(key)
            key, sid = key[order], sid[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            low, high = np.minimum.reduceat(sid, first), np.maximum.reduceat(sid, first)
            many = np.repeat(low < high, np.diff(np.append(first, len(key))))
            key, sid = np.concatenate([key[first], key[many] | U(1)]), np.concatenate([low, sid[many]])
            for lo in range(0, len(key), 200_000):
                yield pa.RecordBatch.from_arrays([signed(key[lo : lo + 200_000]), pa.array(sid[lo : lo + 200_000])], ["key", "sid"])

        for _, _, sets, offsets, ids in set_rows(batches, k):
            got = bands.cells(sets, offsets, ids)
            lot.append(got)
            held += len(got[0])
            if held > 800_000:
                yield from combined()
                lot, held = [], 0
        if held:
            yield from combined()

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by key: those told apart already (odd keys), and runs of two or more sets."""
        kept = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key, sid = (np.concatenate([kept[i], batch.column(i).to_numpy()]) for i in (0, 1))
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            yield of_runs(key[:cut], sid[:cut])
            kept = key[cut:], sid[cut:]
        yield of_runs(*kept)

    def of_runs(key: np.ndarray, sid: np.ndarray) -> pa.RecordBatch:
        if len(key):
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            several = sid[first] < sid[np.append(first[1:], len(sid)) - 1]
            keep = np.repeat(several, np.diff(np.append(first, len(key)))) | ((key & 1) == 1)
            key, sid = key[keep] & ~1, sid[keep]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(sid)], ["region", "sid"])

    found = docs.select("text").mapInArrow(lean(project), "key long, sid long")
    place = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, F.col("sid")).otherwise(F.col("key"))
    return found.repartition(place).sortWithinPartitions("key", "sid").mapInArrow(lean(survivors), "region long, sid long")


def avoided(members: DataFrame, percent: int) -> DataFrame:
    """region, sid of members without those rows of large regions that their set can do without."""
    count = members.groupBy("region").agg(F.count("*").alias("c"))
    limit = F.array(*[F.lit(x) for x in Bands(percent).limits()])
    projection = F.shiftright("region", 1).bitwiseAND(F.lit(511)).cast("int")
    sized_ = members.join(count, "region").withColumn("projection", projection)
    large = sized_.where(F.col("c") > HOT)
    leave = large.groupBy("sid", "projection").agg(F.count("*").alias("h")).where(F.col("h") <= F.element_at(limit, F.col("projection") + 1)).select("sid", "projection")
    kept = large.join(leave, ["sid", "projection"], "left_anti")
    return sized_.where(F.col("c") <= HOT).select("region", "sid").unionByName(kept.select("region", "sid"))


def of_points(docs: DataFrame, points: DataFrame, wanted: DataFrame, k: int, whole: bool) -> DataFrame:
    """sid, n and set (array<long>, if `whole`) or sketch (array<long>) of the wanted sids, each from one of its rows."""
    last = "set" if whole else "sketch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, sets, offsets, ids in set_rows(batches, k):
            n = np.diff(offsets)
            if whole:
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), signed(sets))
            else:
                rows = max(1, len(n))
                cell = np.repeat(np.arange(len(n)), n) * SKETCH_BITS + (sets % U(SKETCH_BITS)).astype(np.int64)
                odd = np.bincount(cell, minlength=rows * SKETCH_BITS)[: len(n) * SKETCH_BITS].astype(np.uint8) & 1
                bits = np.packbits(odd.reshape(len(n), SKETCH_BITS), axis=1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (SKETCH_BITS // 64)), pa.array(bits.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), lists], ["sid", "n", last])

    rows = points.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    hint = sized(rows)
    own = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    some = own.join(hint(rows.select(F.col("doc_id").alias("p")).distinct()), F.col("doc_id").eqNullSafe(F.col("p")), "left_semi")
    found = some.select("text").mapInArrow(lean(run), f"sid long, n long, {last} array<long>")
    return found.join(hint(rows.select("sid")), "sid", "left_semi").dropDuplicates(["sid"])


def sized(rows: DataFrame):
    """broadcast for few rows, else nothing."""
    return F.broadcast if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else (lambda df: df)


def one_each(members: DataFrame) -> DataFrame:
    """Of regions (region, sid, ...) with the same members one, with their number c."""
    h = lambda *x: F.bit_xor(F.xxhash64("sid", *x))
    marks = members.groupBy("region").agg(F.count("*").alias("c"), h().alias("x"), h(F.lit(1)).alias("y"))
    return members.join(marks.where("c > 1").groupBy("c", "x", "y").agg(F.min("region").alias("region")).select("region", "c"), "region")


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The bits in which each line of x differs from each line of y."""
    out = np.zeros((len(x), len(y)), np.int64)
    for word in range(x.shape[1]):
        out += np.bitwise_count(x[:, word, None] ^ y[None, :, word])
    return out


def near_pairs(marks: np.ndarray, n: np.ndarray, root: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Lines i, j of a region's sets (sketches, sizes, roots) that may link: a recursive Voronoi join on the sketches."""
    percent = bands.percent
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    todo = [np.arange(len(n))]

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        both = n[i][:, None] + n[j][None, :]
        fits = np.minimum(n[i][:, None], n[j][None, :]) * 100 >= percent * np.maximum(n[i][:, None], n[j][None, :])
        fits &= (root[i][:, None] != root[j][None, :]) & (i[:, None] < j[None, :])
        if fits.any():
            x, y = np.nonzero(fits & (apart(marks[i], marks[j]) * (100 + percent) <= (100 - percent) * both))
            found.append((i[x], j[y]))

    while todo:
        at = todo.pop()
        if len(np.unique(root[at])) < 2:
            continue
        if len(at) <= PART:
            compare(at, at)
            continue
        # How far from each set one that it links with can be; pivots are taken far from each other.
        most = bands.differ(n[at])
        pivots = [0]
        dist = apart(marks[at], marks[at[:1]])
        for _ in range(PART_PIVOTS - 1):
            pivots.append(int(dist.min(axis=1).argmax()))
            dist = np.concatenate([dist, apart(marks[at], marks[at[pivots[-1:]]])], axis=1)
        inside = dist <= (dist.min(axis=1) + 2 * most)[:, None]
        if inside.sum() <= 2 * len(at) and inside.sum(axis=0).max() < len(at):
            todo += [at[inside[:, k]] for k in range(len(pivots))]
            continue
        # Too near each other for regions: in the order of distances to one pivot, each set meets those within the window.
        order = np.argsort(dist[:, 0], kind="stable")
        line, far, most = at[order], dist[order, 0], most[order]
        for lo in range(0, len(line), PART):
            end = int(np.searchsorted(far, (far[lo : lo + PART] + most[lo : lo + PART]).max(), "right"))
            some, later = line[lo : lo + PART], line[lo:end]
            compare(some, later)
            compare(later[PART:], some)
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j


def joined_regions(members: DataFrame, percent: int) -> DataFrame:
    """a > b of the members (region, sid, n, root, sketch) of small regions that may link."""

    bands = Bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def pairs(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            region, sid, n, root = (t.column(c).to_numpy() for c in ("region", "sid", "n", "root"))
            marks = t.column("sketch").combine_chunks().flatten().to_numpy().view(U).reshape(len(n), -1)
            edge = np.append(np.flatnonzero(np.append(True, region[1:] != region[:-1])), len(n))
            out = [np.zeros((2, 0), np.int64)]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                i, j = near_pairs(marks[lo:hi], n[lo:hi], root[lo:hi], bands)
                out.append(np.stack([sid[lo + i], sid[lo + j]]))
            both = np.unique(np.sort(np.concatenate(out, axis=1), axis=0), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[1]), pa.array(both[0])], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            kept = t if kept is None else pa.concat_tables([kept, t])
            region = kept.column("region").to_numpy()
            cut = int(np.searchsorted(region, region[-1])) if len(region) else 0
            if cut:
                yield pairs(kept.slice(0, cut))
                kept = kept.slice(cut)
        if kept is not None and len(kept):
            yield pairs(kept)

    by_region = members.select("region", "sid", "n", "root", "sketch").repartition("region").sortWithinPartitions("region")
    return by_region.mapInArrow(lean(run), "a long, b long").distinct()


def voronoi_parts(large: DataFrame, percent: int) -> DataFrame:
    """whole, region, sid: the Voronoi regions that PIVOTS members of each region (whole) make, members near a border in both."""
    turn = F.row_number().over(W.partitionBy("region", "root").orderBy("rank"))
    place = F.row_number().over(W.partitionBy("region").orderBy("turn", "rank"))
    ranked = large.select("region", "root", "sid", "sketch", F.xxhash64("sid").alias("rank"))
    heads = ranked.withColumn("turn", turn).where(F.col("turn") <= PIVOTS).withColumn("place", place).where(F.col("place") <= PIVOTS)
    heads = heads.groupBy("region").agg(F.flatten(F.collect_list("sketch")).alias("marks"))  # PIVOTS sketches
    bands = Bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region, sid, n = (batch.column(i).to_numpy() for i in (0, 1, 2))
            most = bands.differ(n)
            out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for i in range(len(region)):
                own = np.array(batch.column(3)[i].values).view(U)[None, :]
                far = apart(own, np.array(batch.column(4)[i].values).view(U).reshape(-1, own.shape[1]))[0]
                near = np.flatnonzero(far <= far.min() + 2 * most[i])
                out.append((np.full(len(near), i), near))
            at, pivot = (np.concatenate(x) for x in zip(*out, strict=True))
            part = mix(region[at].view(U) + mix(pivot.astype(U) + U(1))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(region[at]), pa.array(part), pa.array(sid[at])], ["whole", "region", "sid"])

    return large.join(heads, "region").select("region", "sid", "n", "sketch", "marks").mapInArrow(lean(run), "whole long, region long, sid long")


def block_parts(large: DataFrame) -> DataFrame:
    """region, sid of pairs of blocks of each region: blocks of large components, and of small ones together, but for pairs within one component."""
    most = LEAF // 2
    parts = lambda c: F.ceil(F.col(c) / most)
    comps = large.groupBy("region", "root").agg(F.count("*").alias("c_root"))
    rest = comps.where(F.col("c_root") <= most).groupBy("region").agg(F.sum("c_root").alias("c_rest"))
    with_sizes = large.select("region", "sid", "root").join(comps, ["region", "root"]).join(rest, "region", "left")
    whole = F.when(F.col("c_root") > most, F.col("root"))  # a block of one component
    block = F.when(whole.isNotNull(), F.xxhash64("root", F.pmod(F.xxhash64("sid"), parts("c_root")))).otherwise(F.pmod(F.xxhash64("root"), parts("c_rest")))
    at = with_sizes.select("region", "sid", block.alias("block"), whole.alias("whole"))
    blocks = at.select("region", "block", "whole").distinct()
    other = blocks.select("region", F.col("block").alias("block2"), F.col("whole").alias("whole2"))
    pairs = blocks.join(other, "region").where((F.col("block") <= F.col("block2")) & (F.col("whole").isNull() | F.col("whole2").isNull() | (F.col("whole") != F.col("whole2"))))
    pairs = pairs.select("region", F.xxhash64("region", "block", "block2").alias("part"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    return at.join(pairs, ["region", "block"]).select(F.col("part").alias("region"), "sid")


def link_components(docs: DataFrame, k: int, percent: int, stash: Stash) -> tuple[DataFrame, DataFrame]:
    """measured() rows, and (node, root) of the sets that link with another, both written by stash."""
    points = stash(measured(docs, k))
    members = stash(regions(docs, k, percent).distinct())
    single = stash(one_each(avoided(members, percent)))
    stash.drop(members)
    # A set that meets many others in its regions is central; central sets make good pivots.
    central = single.groupBy("sid").agg(F.struct(F.sum("c").alias("weight"), "sid").alias("rank"))
    ranked = stash(single.join(central, "sid").select("region", "sid", "rank"))
    stash.drop(single)
    marks = stash(of_points(docs, points, ranked.select("sid").distinct(), k, whole=False))

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches leave room for a link; the others can't have one."""
        a = marks.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
        b = marks.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
        bits = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        fits = F.least("n_a", "n_b") * 100 >= percent * F.greatest("n_a", "n_b")
        return pairs.join(a, "a").join(b, "b").where(fits & (bits * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b")))).select("a", "b")

    def linked(pairs: DataFrame) -> DataFrame:
        """The distinct pairs (a, b) that link, by their whole sets; only sets of these pairs travel."""
        pairs = stash(pairs.distinct())
        sets = stash(of_points(docs, points, pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct(), k, whole=True))
        a = sets.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("set").alias("set_a"))
        b = sets.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("set").alias("set_b"))
        both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        met = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", both.alias("both"))
        links = stash(met.where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b"))
        stash.drop(pairs, sets)
        return links

    pivot = ranked.groupBy("region").agg(F.max("rank").alias("pivot"))
    first = ranked.join(pivot, "region").groupBy("sid").agg(F.max("pivot").alias("p")).select(F.col("sid").alias("a"), F.col("p.sid").alias("b")).where("a <> b")
    links = linked(possible(first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    roots = merged(None, links, stash)
    stash.drop(links)

    def opened(at: DataFrame) -> DataFrame:
        """region, sid, root, c (the region's members) of the regions that hold several components."""
        rooted = at.join(roots, F.col("sid") == F.col("node"), "left").select("region", "sid", F.coalesce("root", "sid").alias("root"))
        several = rooted.groupBy("region").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("c")).where("r0 < r1").select("region", "c")
        return rooted.join(several, "region")

    def marked(at: DataFrame) -> DataFrame:
        return at.join(marks, "sid")

    def small(at: DataFrame) -> DataFrame:
        return stash(joined_regions(marked(at.where(F.col("c") <= LEAF)), percent))

    def blocks(at: DataFrame) -> DataFrame:
        return stash(joined_regions(marked(opened(block_parts(at).distinct())), percent))

    at = stash(opened(ranked.select("region", "sid")))
    stash.drop(ranked)
    near = [small(at)]
    large = at.where(F.col("c") > LEAF)
    if not large.isEmpty():
        parts = stash(voronoi_parts(marked(large), percent))
        copied = parts.groupBy("whole").agg(F.count("*").alias("rows"), F.count_distinct("sid").alias("sets")).where(F.col("rows") > COPIES * F.col("sets")).select(F.col("whole").alias("region"))
        near.append(blocks(large.join(copied, "region", "left_semi")))
        parted = parts.join(copied.withColumnRenamed("region", "whole"), "whole", "left_anti").select("region", "sid").distinct()
        inner = stash(opened(one_each(parted).drop("c")))
        near += [small(inner), blocks(inner.where(F.col("c") > LEAF))]
        stash.drop(parts, inner)
    pairs = near[0]
    for more in near[1:]:
        pairs = pairs.unionByName(more)
    links = linked(pairs)
    old, roots = roots, merged(roots, links, stash)
    stash.drop(at, marks, old, links, *near)
    return points, roots


def joined(docs: DataFrame, k: int = 5, percent: int = 80, stash: Stash | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs: the least doc_id that links lead to, itself included."""
    stash = stash or Stash(docs.sparkSession, "jaccard")
    points, roots = link_components(docs, k, percent, stash)
    rows = points.join(roots, F.col("sid") == F.col("node"), "left").select("doc_id", "n", F.coalesce("root", "sid").alias("root"))
    # Sums first: a group of any size sends a row a task to one place; the way back is a join that splits large keys.
    least = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c")).where("c > 1").drop("c")
    out = rows.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, stash: Stash | None = None) -> DataFrame:
    """The rows of docs but for one of each component: that of the least doc_id; rows without shingles all stay."""
    stash = stash or Stash(docs.sparkSession, "jaccard")
    points, roots = link_components(docs, k, percent, stash)
    rows = points.where("n > 0").join(roots, F.col("sid") == F.col("node"), "left").select("doc_id", "sid", F.coalesce("root", "sid").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sid")
    best = rows.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("c")).where("c > 1").select("root", "best")
    # What goes are rows other than the best; they are fewer than those that stay.
    gone = rows.join(best, "root").where(order != F.col("best")).select(F.col("doc_id").alias("gone_id"), F.col("sid").alias("gone_set")).distinct()
    gone = stash(gone)
    repeated = not points.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    stash.drop(points, roots)
    names, ddl = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    text, key, size, gone_id, gone_set = fresh_names(docs, "text0", "set", "n", "gone_id", "gone_set")
    gone = sized(gone)(gone.select(F.col("gone_id").alias(gone_id), F.col("gone_set").alias(gone_set)))
    if not repeated:  # an id tells the row
        return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)), "left_anti")

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, _, offsets, ids in set_rows(batches, k):
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, len(ids)) for i in range(1, len(names) + 1)), pa.array(ids), pa.array(np.diff(offsets))], [*names, key, size])

    tagged = docs.select(docs["text"].alias(text), *[docs[f"`{c}`"] for c in names]).mapInArrow(lean(tag), f"{ddl}, `{key}` long, `{size}` long")
    kept = tagged.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_set)), "left_anti")
    with_set = kept.where(F.col(size) > 0).dropDuplicates(["doc_id", key])  # rows repeated with their id
    return with_set.unionByName(kept.where(F.col(size) == 0)).select(*[F.col(f"`{c}`") for c in names])
