"""What comes from outside: tokenizers, embedders, and a model's replies, which are tables here.

A tokenizer or embedder is a function from a Column to a Column; those below run in the JVM, and a pandas_udf fits in
their place. A reply provider turns (key, prompt) rows into (key, reply) rows; replies are kept in a log and are only
asked for once a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams, norm_tokens
from ..operators.gauntlet import last_write_wins, without_done

Tokenizer = Callable[[Column], Column]
Embedder = Callable[[Column], Column]
Provider = Callable[[DataFrame], DataFrame]


def hashed_embedder(d: int = 64, n: int = 2) -> Embedder:
    """Counts of hashed word n-grams in d places, signs by hash, scaled to unit length (zero for a text without any)."""

    def embed(text: Column) -> Column:
        grams = F.transform(ngrams(norm_tokens(text), n), lambda g: F.xxhash64(g))
        place = lambda i: F.aggregate(grams, F.lit(0.0), lambda t, h: t + F.when(F.pmod(h, F.lit(d)) == i, F.when(F.shiftright(h, 40).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)).otherwise(0.0))
        raw = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), place)
        return F.element_at(F.transform(F.array(raw), lambda v: F.transform(v, lambda x: F.coalesce(F.try_divide(x, F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, y: t + y * y))), F.lit(0.0)))), 1)

    return embed


def table_provider(replies: DataFrame) -> Provider:
    """Replies that are there already, (key, reply); keys without one get none."""
    return lambda prompts: prompts.select("key").join(replies.select("key", "reply"), "key")


def ask(prompts: DataFrame, provider: Provider, log: DataFrame) -> DataFrame:
    """key, reply, seq: the log and the replies to prompts (key, prompt) whose key is not in it; the later one counts."""
    new = provider(without_done(prompts, log, ["key"])).withColumn("seq", F.lit(1 << 62).cast("long"))
    return last_write_wins(log.select("key", "reply", "seq").unionByName(new.select("key", "reply", "seq")), ["key"], "seq")


def parsed(replies: DataFrame, schema: str) -> DataFrame:
    """Replies read as JSON under `parsed`; what is no such JSON is left out, to be asked for again."""
    return replies.withColumn("parsed", F.from_json("reply", schema)).where(F.col("parsed").isNotNull())


def records(chunks: DataFrame, replies: DataFrame, abstain: str) -> DataFrame:
    """Raw pairs of chunks (key, chunk_id, doc_id, source, task, text): one reply holds several questions, or one auxiliary pair."""
    item = "struct<question:string,answer:string,quote:string,difficulty:string,instruction:string>"
    listed = F.when(F.startswith(F.ltrim("reply"), F.lit("[")), F.from_json("reply", f"array<{item}>")).otherwise(F.array(F.from_json("reply", item)))
    r = chunks.join(replies, "key").select("chunk_id", "doc_id", "source", "task", F.col("text").alias("passage"), F.explode(listed).alias("r")).where(F.col("r").isNotNull())
    empty = F.lit("")
    asked = F.col("task").isin("qa", "unanswerable")
    return r.select(
        "chunk_id", "doc_id", "source", "task", F.coalesce(F.when(asked, F.col("r.question")).otherwise(F.col("r.instruction")), empty).alias("question"),
        F.when(F.col("task") == "unanswerable", F.lit(abstain)).otherwise(F.coalesce("r.answer", empty)).alias("answer"),
        F.when(F.col("task") == "qa", F.coalesce("r.quote", empty)).otherwise(empty).alias("quote"),
        F.when(F.col("task") == "qa", F.coalesce("r.difficulty", F.lit("medium"))).otherwise(F.lit("medium")).alias("difficulty"), "passage",
    )


def shots(examples: DataFrame, words: Tokenizer, order: str, k: int, budget: int) -> DataFrame:
    """The most of the first k valid examples (user, assistant) whose tokens fit the budget together, in order."""
    from pyspark.sql.window import Window as W

    first = examples.where("user is not null and assistant is not null").orderBy(order).limit(k)
    size = F.size(words(F.col("user"))) + F.size(words(F.col("assistant")))
    return first.withColumn("upto", F.sum(size).over(W.orderBy(order))).where(F.col("upto") <= budget)  # k rows
