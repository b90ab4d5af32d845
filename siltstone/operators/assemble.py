"""Chat, retrieval and preference examples from pairs; rendering and loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ABSTAIN, QUOTE_CLOSE, QUOTE_OPEN

# Fixed texts of the system turns.
SYS_GROUNDED = "You are a precise legal and financial assistant. Answer clearly using the provided context; do not invent facts."
SYS_CLOSED = "You are a precise legal and financial assistant. Answer clearly and accurately."
SYS_RAFT = (
    "You are a grounded assistant. Answer using ONLY the provided documents. Quote the exact supporting text, "
    f"then give your answer. If the answer is not in the documents, reply exactly: {ABSTAIN}"
)


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(system: Column, user: Column, assistant: Column) -> Column:
    return F.array(turn("system", system), turn("user", user), turn("assistant", assistant))


def numbered_context(docs: Column) -> Column:
    return F.array_join(F.transform(docs, lambda t, i: F.concat(F.lit("[Document "), (i + 1).cast("string"), F.lit("]\n"), t)), "\n\n")


def grounded_user(passage: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), passage, F.lit("\n\nQuestion: "), question)


def documents_user(docs: Column, question: Column) -> Column:
    return F.concat(numbered_context(docs), F.lit("\n\nQuestion: "), question)


def quoted_answer(quote: Column, answer: Column) -> Column:
    return F.concat(F.lit(f"{QUOTE_OPEN} "), quote, F.lit(f" {QUOTE_CLOSE}\n"), answer)


def insert_at(docs: Column, h: Column, golden: Column) -> Column:
    """golden put into the list at one of its size + 1 places, by a hash."""
    return F.array_insert(docs, F.pmod(h, F.size(docs) + 1).cast("int") + 1, golden)


def four_conditions(question: Column, answer: Column, golden: Column, distractors: Column, shuffled: Column) -> Column:
    """An array of (cond, system, user, ref), one for each matched condition."""
    one = lambda cond, system, user, ref: F.struct(F.lit(cond).alias("cond"), F.lit(system).alias("system"), user.alias("user"), ref.alias("ref"))
    return F.array(
        one("clean", SYS_RAFT, documents_user(F.array(golden), question), answer),
        one("realistic", SYS_RAFT, documents_user(shuffled, question), answer),
        one("retrieval_failure", SYS_RAFT, documents_user(distractors, question), F.lit(ABSTAIN)),
        one("closed_book", SYS_CLOSED, question, answer),
    )


def render_custom(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("<|eos|>\n"))), "")


def render_gemma(messages: Column) -> Column:
    """Turns of a model without a system role: the system text goes in front of the first user turn."""
    system = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n\n")
    rest = F.filter(messages, lambda m: m["role"] != "system")
    first = F.array_position(F.transform(rest, lambda m: m["role"]), F.lit("user")) - 1

    def one(m: Column, i: Column) -> Column:
        content = F.when((i == first) & (system != ""), F.concat(system, F.lit("\n\n"), m["content"])).otherwise(m["content"])
        role = F.when(m["role"] == "assistant", F.lit("model")).otherwise(m["role"])
        return F.concat(F.lit("<start_of_turn>"), role, F.lit("\n"), content, F.lit("<end_of_turn>\n"))

    return F.concat(F.lit("<bos>"), F.array_join(F.transform(rest, one), ""))


def loss_mask(messages: Column, words, most: int) -> Column:
    """1 for each token of an assistant turn and its end mark, -100 for others, cut at `most`; words: content -> tokens."""
    def one(m: Column) -> Column:
        own = F.size(words(m["content"]))
        return F.when(m["role"] == "assistant", F.concat(F.array_repeat(F.lit(-100), 1), F.array_repeat(F.lit(1), own + 1))).otherwise(F.array_repeat(F.lit(-100), own + 2))

    return F.slice(F.flatten(F.transform(messages, one)), 1, most)


def gemma_mask(messages: Column, words) -> Column:
    """Of render_gemma()'s tokens by `words`, -100 for all up to the last model turn's beginning, 1 behind it."""
    text = render_gemma(messages)
    mark = "<start_of_turn>model\n"
    answer = F.substring_index(text, mark, -1)
    before = F.size(words(text)) - F.size(words(answer))
    return F.concat(F.array_repeat(F.lit(-100), before), F.array_repeat(F.lit(1), F.size(words(answer))))


def preference(kept: DataFrame) -> DataFrame:
    """Triplets (prompt, chosen, rejected, meta) of confirmed preferences."""
    prompt = F.array(turn("system", F.lit(SYS_GROUNDED)), turn("user", grounded_user(F.col("passage"), F.col("question"))))
    meta = F.struct("source", F.col("margin").alias("judge_margin"), "prompt_id")
    return kept.select(prompt.alias("prompt"), "chosen", "rejected", meta.alias("meta"))


def preference_rows(prefs: DataFrame) -> DataFrame:
    """Two rows for each triplet, chosen and rejected as the assistant's turn."""
    both = F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen").alias("reply")), F.struct(F.lit("rejected").alias("side"), F.col("rejected").alias("reply")))
    rows = prefs.withColumn("s", F.explode(both)).withColumn("side", F.col("s.side"))
    return rows.withColumn("messages", F.concat("prompt", F.array(turn("assistant", F.col("s.reply"))))).drop("s", "chosen", "rejected", "prompt")
