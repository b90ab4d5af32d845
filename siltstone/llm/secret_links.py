"""Secret scans with multipart credential linking, in DataFrame functions alone.

Base spans are found by pattern. Beside them, weak parts (account identifiers, random-looking strings, endpoints)
are gathered as intervals and joined within a scope, a stretch of `scope` code points of one text: a weak
identifier is reported only where a secret starts within the scope, a weak secret only where an identifier does,
an endpoint only where both do. The join is on (row, bin of the scope's width) with the bins on either side; each
bin holds, for each role, only its least and greatest start, so a text full of parts makes no pairs.

Each text is parsed once and its spans are written to the shared folder; work is close to linear in a text's matches
(running sums and edges are taken in blocks of BLOCK).

Null texts count as empty and have no spans; repeated rows get the same result each; a null doc_id is a key like
others. Positions are code points, ends exclusive. Input columns other than the key and the text are left out of
the join and pass in redact(), whatever their names. Nothing is cut from long texts. Empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Stash, fresh_names

# Fixed patterns of the base kinds, in the order in which they sort.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 or more: a shorter run has no longer one inside
HEX = r"[0-9a-f]{16,}"  # [0-9a-f]+ of 16 or more, likewise
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

IDENTIFIER = r"""(?i:client|account|tenant|user|access_?key)[_-]?(?i:id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{4,})"""
RANDOM = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}"
ENDPOINT = r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\x20\x09-\x0D"'<>]*)?"""
SCOPE = 256
BLOCK = 128

SPAN = "array<struct<start:int,kind:int,stop:int>>"


def given(x: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def blocks(xs: Column) -> Column:
    """The array in arrays of BLOCK."""
    return given(xs, lambda a: F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda i: F.slice(a, i * BLOCK + 1, BLOCK))).otherwise(F.array().cast("array<array<int>>")))


def running(xs: Column, plus) -> Column:
    """Of an array of int, for each place 0 plus all values before it; plus: associative, 0 its neutral value."""
    scan = lambda a, value: F.aggregate(a, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct(plus(acc["at"], value(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
    inner = F.transform(blocks(xs), lambda block: scan(block, lambda x: x))
    return given(inner, lambda parts: F.flatten(F.zip_with(parts, scan(parts, lambda p: p["at"])["out"], lambda p, base: F.transform(p["out"], lambda x: plus(base, x)))))


def spans_of(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of the leftmost non-overlapping matches. What lies between them has the lengths that place them."""

    def placed(both: Column) -> Column:
        found, gaps = both["found"], both["gaps"]
        length = F.transform(F.arrays_zip(found.alias("m"), gaps.alias("gap")), lambda x: x["gap"] + F.length(x["m"]))
        start = F.zip_with(running(length, lambda a, b: a + b), gaps, lambda before, gap: before + gap)
        spans = F.zip_with(start, found, lambda at, m: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(m)).alias("stop"), (F.lit(True) if keep is None else keep(m)).alias("kept")))
        return F.transform(F.filter(spans, lambda s: s["kept"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = given(F.transform(F.split(text, pattern, -1), F.length), lambda g: F.slice(g, F.lit(1), F.size(g) - 1))
    return F.when(text.rlike(pattern), given(F.struct(found.alias("found"), gaps.alias("gaps")), placed)).otherwise(F.array().cast(SPAN))


def long_value(m: Column) -> Column:
    return F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12


def looks_random(m: Column) -> Column:
    return m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")


def base_spans(text: Column) -> list[Column]:
    return [spans_of(text, ASSIGN, 0, long_value), spans_of(text, ACCESS, 1), spans_of(text, HEX, 2)]


def weak_spans(text: Column) -> list[Column]:
    return [spans_of(text, IDENTIFIER, 3), spans_of(text, RANDOM, 4, looks_random), spans_of(text, ENDPOINT, 5)]


def linked(parts: DataFrame, keys: list[str], scope: int = SCOPE) -> DataFrame:
    """Of parts (keys, start, kind, stop), the weak ones whose complementary parts start within `scope` of them."""
    role = F.when(F.col("kind").isin(1, 3), F.lit("id")).when(F.col("kind").isin(0, 4), F.lit("secret"))
    bins = (
        parts.withColumn("role", role).where("role is not null")
        .groupBy(*keys, F.floor(F.col("start") / scope).alias("bin"), "role")
        .agg(F.min("start").alias("low"), F.max("start").alias("high"))
    )
    wanted = F.when(F.col("kind") == 3, F.array(F.lit("secret"))).when(F.col("kind") == 4, F.array(F.lit("id"))).otherwise(F.array(F.lit("id"), F.lit("secret")))
    own = F.floor(F.col("start") / scope)
    weak = parts.where("kind >= 3").distinct().withColumn("role", F.explode(wanted)).withColumn("near", F.explode(F.array(own - 1, own, own + 1)))
    b = bins.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("bin").alias("b_bin"), F.col("role").alias("b_role"), "low", "high")
    same = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys]
    # In the bin before, its greatest start is the nearest; in the bin after, its least; in the own bin any will do.
    near = (
        (F.col("b_bin") == own)
        | ((F.col("b_bin") < own) & (F.col("high") >= F.col("start") - scope))
        | ((F.col("b_bin") > own) & (F.col("low") <= F.col("start") + scope))
    )
    met = weak.join(b, [*same, F.col("near") == F.col("b_bin"), F.col("role") == F.col("b_role"), near], "left_semi")
    span = [*keys, "start", "kind", "stop"]
    return met.select(*span, "role").distinct().groupBy(*span).agg(F.count("*").alias("n")).where("n = if(kind = 5, 2, 1)").select(*span)


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """One row per input row: id, hash (of the text), base (its base spans), spans (base and linked ones), in order."""
    t = F.coalesce(F.col("text"), F.lit(""))
    docs = df.select(df[f"`{doc_id}`"].alias("id"), df[f"`{text}`"].alias("text"))
    parsed = docs.select("id", F.xxhash64(t).alias("hash"), F.array_sort(F.concat(*base_spans(t))).alias("base"), F.concat(*weak_spans(t)).alias("weak"))
    parsed = Stash(df.sparkSession, "secrets")(parsed)
    parts = parsed.where(F.size("weak") > 0).dropDuplicates(["id", "hash"]).select("id", "hash", F.explode(F.concat("base", "weak")).alias("p")).select("id", "hash", "p.start", "p.kind", "p.stop")
    # A weak span that meets a base span says nothing new: the greatest end before it and the least start behind it tell.
    order = W.partitionBy("id", "hash").orderBy("start", "kind", "stop")
    base = lambda c: F.when(F.col("kind") < 3, F.col(c))
    reach = F.coalesce(F.max(base("stop")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(0))
    ahead = F.min(base("start")).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    parts = parts.withColumn("reach", reach).withColumn("ahead", ahead)
    free = (F.col("reach") <= F.col("start")) & (F.col("ahead").isNull() | (F.col("ahead") >= F.col("stop")))
    parts = parts.where((F.col("kind") < 2) | ((F.col("kind") >= 3) & free)).drop("reach", "ahead")
    more = linked(parts, ["id", "hash"], scope).groupBy("id", "hash").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("more"))
    m = more.select(F.col("id").alias("m_id"), F.col("hash").alias("m_hash"), "more")
    out = parsed.join(m, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("hash") == F.col("m_hash")), "left")
    return out.select("id", "hash", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(df: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan(df, text, doc_id, scope).select(
        F.col("id").alias(doc_id), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


def redact(df: DataFrame, text: str = "text", doc_id: str = "doc_id", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """The input with every span in its texts replaced by `mark`; overlapping spans count as one. A null text stays null."""
    id_, hash_, spans = fresh_names(df, "id", "hash", "spans")
    hit = scan(df, text, doc_id, scope).where(F.size("spans") > 0).dropDuplicates(["id", "hash"]).select(F.col("id").alias(id_), F.col("hash").alias(hash_), F.col("spans").alias(spans))
    t = df[f"`{text}`"]
    joined = df.join(hit, df[f"`{doc_id}`"].eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(t, F.lit(""))) == F.col(hash_)), "left")

    def cut(xs: Column) -> Column:
        """Blocks of pieces, each cut from its own part of the text; a piece is what lies before a span that begins no earlier than others end."""
        reach = running(F.transform(xs, lambda s: s["stop"]), F.greatest)
        edges = F.zip_with(xs, reach, lambda s, r: F.struct(r.alias("at"), s["start"].alias("to"), s["stop"].alias("stop")))
        pieces = F.filter(edges, lambda e: e["to"] >= e["at"])
        last = F.array_max(F.transform(xs, lambda s: s["stop"]))

        def block(b: Column) -> Column:
            first, end = F.element_at(b, 1)["at"], F.element_at(b, -1)["to"]
            part = F.substring(t, first + 1, end - first)
            return given(part, lambda p: F.array_join(F.transform(b, lambda e: F.concat(F.substring(p, e["at"] - first + 1, e["to"] - e["at"]), F.lit(mark))), ""))

        grouped = given(pieces, lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda i: F.slice(a, i * BLOCK + 1, BLOCK)))
        return F.concat(F.array_join(F.transform(grouped, block), ""), F.substring(t, last + 1, F.length(t)))

    new = F.when(F.col(spans).isNotNull() & t.isNotNull(), given(F.col(spans), cut)).otherwise(t)
    return joined.select(*[new.alias(c) if c == text else df[f"`{c}`"] for c in df.columns])
