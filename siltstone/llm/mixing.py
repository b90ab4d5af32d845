"""Mixing sources to target weights.

Each source is one stream of words: its documents in hashed order, cut into blocks of `block` words (the last one
may be shorter). A source's slots run through its blocks pass by pass, each pass in the order of a keyed Feistel
permutation of the block numbers, the short block last. Output shards hold `shard` slots; how many slots of each
source a shard gets is a multinomial draw on the condition that all shards together use up each source's slots
(a multivariate hypergeometric one), found by halving the shards from the whole down with a generator keyed by the
node, so every task draws its own shards alone and reruns agree. Slots then meet their blocks in a join by index.

Sources may be of any size: offsets come from sums within hashed buckets of about BUCKET_ROWS rows, blocks spread a
large source over all tasks. One row a source (name, weight, sizes) reaches the driver, where the weights are.

Null texts have no words and are never taken; a null source is a source of its own, last. Repeated rows are mixed
as rows, each with its own place in its source. An empty table gives an empty mix. Columns other than those named pass
by untouched, whatever their names."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Stash, fresh_names, lean
from .secret_links import given
from .words import mix

BUCKET_ROWS = 1_000
WORD = r"[^\x20\x09-\x0D]+"
PIECE = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


@dataclass
class Source:
    name: str | None
    size: int
    weight: float
    target: float = 0.0


def targets(sources: list[Source], total: float, cap: float = 2.0, floor: float = 0.0) -> None:
    """Share `total` by weight; none gets over cap or under floor times its size, and what that frees or takes is shared anew."""
    fixed: dict[int, float] = {i: s.size * floor for i, s in enumerate(sources) if not s.size}
    left = total - sum(s.size * floor for s in sources)
    while True:
        going = [i for i in range(len(sources)) if i not in fixed]
        weight = sum(sources[i].weight for i in going)
        rest = left - sum(fixed[i] - sources[i].size * floor for i in fixed)
        over = [i for i in going if sources[i].size * floor + rest * sources[i].weight / weight > cap * sources[i].size]
        if not over:
            break
        fixed.update((i, cap * sources[i].size) for i in over)
    for i, s in enumerate(sources):
        s.target = fixed[i] if i in fixed else s.size * floor + rest * s.weight / weight


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good, exact at every size.

    Few draws are made one by one, more by the ratio of uniforms under a table-mountain hat (Stadlober's HRUA)."""
    total = good + bad
    m, few, many = min(n, total - n), min(good, bad), max(good, bad)
    if m <= 10:
        z, left = 0, few
        for i in range(m):
            if rng.random() * (total - i) < left:
                z, left = z + 1, left - 1
    else:
        share = few / total
        centre, spread = m * share + 0.5, math.sqrt((total - m) * m * share * (1 - share) / (total - 1) + 0.5)
        width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
        weight = lambda k: math.lgamma(k + 1) + math.lgamma(few - k + 1) + math.lgamma(m - k + 1) + math.lgamma(many - m + k + 1)
        mode = weight((m + 1) * (few + 1) // (total + 2))
        end = min(min(m, few) + 1, math.floor(centre + 16 * spread))
        while True:
            x, y = 1 - rng.random(), rng.random()
            w = centre + width * (y - 0.5) / x
            if 0 <= w < end and 2 * math.log(x) <= mode - weight(math.floor(w)):
                z = math.floor(w)
                break
    if good > bad:
        z = m - z
    return good - z if m < n else z


class Plan:
    """Slots of each source and where a slot's words lie; all numbers follow from sizes, targets and the seed."""

    def __init__(self, sources: list[Source], block: int, shard: int, seed: int):
        self.block, self.shard, self.seed = block, shard, seed
        self.size = np.array([s.size for s in sources], np.int64)
        take = np.rint([s.target for s in sources]).astype(np.int64)
        self.full, self.tail = self.size // block, self.size % block
        self.blocks = self.full + (self.tail > 0)
        whole = np.maximum(self.size, 1)
        self.passes, self.rest = take // whole, take % whole
        self.slots = self.passes * self.blocks + -(-self.rest // block)
        self.shards = int(-(-int(self.slots.sum()) // shard))
        self._nodes: dict[tuple[int, int], np.ndarray] = {}

    def _split(self, counts: np.ndarray, n: int, node: tuple[int, int]) -> np.ndarray:
        """n slots drawn from counts without replacement."""
        if node not in self._nodes:
            rng = np.random.Generator(np.random.Philox(key=[self.seed, node[0] << 32 | node[1]]))
            out, rest, pool = np.zeros(len(counts), np.int64), n, int(counts.sum())
            for i, c in enumerate(counts.tolist()):
                pool -= c
                if not rest:
                    break
                out[i] = x = hypergeometric(rng, c, pool, rest) if c else 0
                rest -= x
            if len(self._nodes) > 5000:
                self._nodes.clear()
            self._nodes[node] = out
        return self._nodes[node]

    def draw(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each source the first slot of a shard and the number of its slots."""
        lo, hi, first, counts = 0, self.shards, np.zeros_like(self.slots), self.slots
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = self._split(counts, (mid - lo) * self.shard, (lo, hi))
            if shard < mid:
                hi, counts = mid, left
            else:
                lo, first, counts = mid, first + left, counts - left
        return first, counts

    def permuted(self, source: int, turn: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Place `place` of the source's full blocks in pass `turn`: four Feistel rounds, walked on until inside."""
        n = int(self.full[source])
        half = np.uint64(max(1, -(-(n - 1).bit_length() // 2)))
        mask = (np.uint64(1) << half) - np.uint64(1)
        x, todo = place.astype(np.uint64), np.arange(len(place))
        keys = mix(np.uint64(self.seed * 1_000_003 + source * 8191) + turn.astype(np.uint64))
        while len(todo):
            a, b = x[todo] >> half, x[todo] & mask
            for r in range(4):
                a, b = b, a ^ (mix(b + keys[todo] * np.uint64(2 * r + 3)) & mask)
            x[todo] = a << half | b
            todo = todo[x[todo] >= np.uint64(n)]
        return x.astype(np.int64)

    def slots_of(self, shard: int) -> pd.DataFrame:
        """The slots of one shard in their order: slot, source_no, pass, block, words."""
        first, counts = self.draw(shard)
        parts = []
        for s in np.flatnonzero(counts).tolist():
            k = np.arange(first[s], first[s] + counts[s])
            turn, place = k // self.blocks[s], k % self.blocks[s]
            block, words = place.copy(), np.full(len(k), self.block, np.int64)
            inner = place < self.full[s]
            block[inner] = self.permuted(s, turn[inner], place[inner])
            words[~inner] = self.tail[s]
            last = (turn == self.passes[s]) & (k == self.slots[s] - 1)
            if last.any():
                words[last] = self.rest[s] - place[last] * self.block
            parts.append(np.stack([np.full(len(k), s), turn, block, words]))
        if not parts:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("slot", "source_no", "pass", "block", "words")})
        a = np.concatenate(parts, axis=1)
        order = np.random.Generator(np.random.Philox(key=[self.seed, 1 << 62 | shard])).permutation(a.shape[1])
        a = a[:, order]
        return pd.DataFrame({"slot": np.arange(a.shape[1]), "source_no": a[0], "pass": a[1], "block": a[2], "words": a[3]})


def cyclic_weights(n: int, cycle: tuple[float, ...] = (3, 1, 2)) -> list[float]:
    return [cycle[i % len(cycle)] for i in range(n)]


class Mix:
    """One mix of a table: sources, plan, rows (each row with its place in its source), pieces (what is taken)."""

    def __init__(self, docs: DataFrame, stash: Stash, weights=cyclic_weights, share: float = 1.5, cap: float = 2.0, floor: float = 0.0, block: int = 64, shard: int = 4096, seed: int = 20):
        spark = docs.sparkSession
        text = F.coalesce(docs["text"], F.lit(""))
        sized = stash(docs.select(docs["doc_id"], docs["source"], F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("hash")))
        found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8")))
        self.sources = [Source(r.source, r.size, w) for r, w in zip(found, weights(len(found)), strict=True)]
        targets(self.sources, share * sum(s.size for s in self.sources), cap, floor)
        self.plan = plan = Plan(self.sources, block, shard, seed)
        listed = [(i, s.name, s.size, float(s.target), -(-r.n // BUCKET_ROWS)) for i, (s, r) in enumerate(zip(self.sources, found, strict=True))]
        numbers = spark.createDataFrame(listed, "source_no int, s_name string, source_size long, target double, buckets long")
        rows = sized.join(F.broadcast(numbers), sized["source"].eqNullSafe(F.col("s_name"))).drop("s_name")  # the driver's row a source
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "hash"), "buckets")).drop("buckets")
        inner = W.partitionBy("source_no", "bucket").orderBy("doc_id", "hash", "size").rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn("off", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("b_size"))
        before = sums.withColumn("b_off", F.coalesce(F.sum("b_size").over(W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        rows = rows.join(before.drop("b_size"), ["source_no", "bucket"]).withColumn("off", F.col("off") + F.col("b_off")).drop("b_off", "bucket")
        self.rows = stash(rows)

        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for s in batch["id"].tolist():
                    got = plan.slots_of(s)
                    got.insert(0, "shard", s)
                    yield got

        # Spark takes the slots for as few bytes as the shards' numbers; the joins are told to shuffle them.
        tasks = max(1, min(plan.shards, 4 * spark.sparkContext.defaultParallelism))
        self.slots = spark.range(0, plan.shards, 1, tasks).mapInPandas(lean(fill), "shard long, slot long, source_no int, pass long, block long, words long")
        last = F.floor((F.col("off") + F.col("size") - 1) / F.lit(block)).cast("long")
        spread = self.rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("off") / F.lit(block)).cast("long"), last)))
        low = F.greatest(F.col("off") - F.col("block") * block, F.lit(0))
        spread = spread.withColumn("low", low).withColumn("high", F.least(F.col("off") + F.col("size") - F.col("block") * block, F.lit(block)))
        word = F.col("block") * block - F.col("off")
        self.spread = spread
        #: One row for each stretch of a document in a slot: words first_word to end_word of the document.
        self.pieces = (
            spread.join(self.slots.hint("merge"), ["source_no", "block"]).where("words > low")
            .select("shard", "slot", "pass", "source", "source_no", "block", "doc_id", "hash", "off", "size", (word + F.col("low")).alias("first_word"), (word + F.least("high", "words")).alias("end_word"))
        )

    def taken(self) -> DataFrame:
        """Per row: doc_id, size, source_size, target, taken, repeats counted."""
        n = F.greatest(F.least("high", "words") - F.col("low"), F.lit(0))
        by = self.slots.groupBy("source_no", "block", "words").agg(F.count("*").alias("times"))
        some = (
            self.spread.join(by.hint("merge"), ["source_no", "block"], "left")
            .groupBy("source_no", "off", "doc_id", "size", "source_size", "target")
            .agg(F.coalesce(F.sum(n * F.col("times")), F.lit(0)).cast("long").alias("taken"))
        )
        cols = ["doc_id", "size", "source_size", "target", "taken"]
        return some.select(*cols).unionByName(self.rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*cols))

    def documents(self, docs: DataFrame) -> DataFrame:
        """The mix as documents: for each row and pass the words taken, in order, under the columns of docs.

        A row taken whole keeps its text as it is; else its stretches, from word to word with what lies between."""
        key = ["doc_id", "source", "hash"]
        whole = self.pieces.groupBy(*key, "off", "size", "pass").agg(F.array_sort(F.collect_list(F.struct("first_word", "end_word"))).alias("ranges"))
        more = self.rows.where("size > 0").groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").select(*key)
        id_, source, hash_, size, spans, copy, text_hash = fresh_names(docs, "id", "from", "hash", "size", "ranges", "copy", "text_hash")
        own = docs.withColumn(text_hash, F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
        same = lambda df: own["doc_id"].eqNullSafe(df[id_]) & own["source"].eqNullSafe(df[source]) & (own[text_hash] == df[hash_])
        named = [F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("hash").alias(hash_)]
        if more.isEmpty():
            ranges = whole.select(*named, F.col("size").alias(size), F.col("ranges").alias(spans))
            own = own.join(ranges, same(ranges))
        else:
            # Rows equal in id, source and text each take one of the places that such rows have in the source.
            place = F.dense_rank().over(W.partitionBy(*key).orderBy("off"))
            places = self.rows.where("size > 0").select(*key, "off").withColumn("place", place)
            ranges = whole.join(places.select(*[F.col(c).alias(f"p_{c}") for c in (*key, "off")], "place"), F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & F.col("source").eqNullSafe(F.col("p_source")) & (F.col("hash") == F.col("p_hash")) & (F.col("off") == F.col("p_off")))
            ranges = ranges.select(*named, F.col("size").alias(size), F.col("ranges").alias(spans), F.col("place").alias(f"{copy}_no"))
            twice = more.select(*named)
            numbered = own.join(twice, same(twice), "left_semi").withColumn(copy, F.row_number().over(W.partitionBy("doc_id", "source", text_hash).orderBy(F.lit(0))))
            own = own.join(twice, same(twice), "left_anti").withColumn(copy, F.lit(1)).unionByName(numbered)
            own = own.join(ranges, same(ranges) & (own[copy] == ranges[f"{copy}_no"]))
        # A piece is a word with the blanks behind it, so a stretch of words is its pieces put together.
        cut = given(F.regexp_extract_all(own["text"], F.lit(PIECE), F.lit(0)), lambda p: F.array_join(F.flatten(F.transform(own[spans], lambda r: F.slice(p, r["first_word"] + 1, r["end_word"] - r["first_word"]))), ""))
        taken = F.aggregate(own[spans], F.lit(0).cast("long"), lambda t, r: t + r["end_word"] - r["first_word"])
        new = F.when(taken == own[size], own["text"]).otherwise(cut)
        mixed = own.select(*[new.alias(c) if c == "text" else own[f"`{c}`"] for c in docs.columns])
        if "n_chars" in docs.columns:
            mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])


__all__ = ["Mix", "Plan", "Source", "targets", "cyclic_weights"]
