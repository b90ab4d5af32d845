"""Quality filters over question-answer pairs: rules, grounding, exact duplicates, verdicts, preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ABSTAIN, content_words, hash_order, norm, text_or_empty, tokens

# Phrases by which a question shows that it is about a text at hand; tasks that are not questions.
SELF_REFERENCES = ("the passage", "the text", "the document", "as stated above")
AUX_TASKS = ("summarize", "extract", "rewrite")


def rule_ok(question="question", answer="answer", quote="quote", passage="passage", task="task", least_q=8, least_a=8, most_a=1200, most_quote=60) -> Column:
    """Lengths in bounds, no template echo; for qa no reference to the passage and a short quote taken from it."""
    q, a = text_or_empty(F.col(question)), text_or_empty(F.col(answer))
    low = F.concat(norm(q), F.lit(" "), norm(a))
    fit = (F.length(q) >= least_q) & F.length(a).between(least_a, most_a) & ~F.contains(low, F.lit("here are"))
    refers = F.lit(False)
    for s in SELF_REFERENCES:
        refers = refers | F.contains(low, F.lit(s))
    quoted = (text_or_empty(F.col(quote)) != "") & (F.instr(norm(F.col(passage)), norm(F.col(quote))) > 0) & (F.size(tokens(F.col(quote))) <= most_quote)
    return fit & (~F.col(task).eqNullSafe("qa") | (~refers & quoted))


def overlap_share(answer: Column, passage: Column) -> Column:
    """Share of the answer's content words that the passage has; null without such words."""
    a = content_words(answer)
    return F.try_divide(F.size(F.array_intersect(a, content_words(passage))), F.size(a))


def grounded_ok(answer="answer", passage="passage", task="task", least=0.55) -> Column:
    share = F.coalesce(overlap_share(F.col(answer), F.col(passage)), F.lit(0.0))
    return ~F.col(task).eqNullSafe("qa") | (F.trim(text_or_empty(F.col(answer))) == ABSTAIN) | (share >= least)


def signature(question="question", answer="answer", task="task") -> Column:
    return F.when(F.col(task).isin(*AUX_TASKS), F.col(answer)).otherwise(F.col(question))


def exact_dedup(df: DataFrame, text: Column, *order: str) -> DataFrame:
    """The first row, by `order`, of each normal form of a text. A least row by key combines within tasks before the shuffle."""
    rest = [c for c in df.columns if c not in order]
    best = df.withColumn("_h", F.sha2(norm(text), 256)).groupBy("_h").agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order)).alias("r"))
    return best.select(*[F.col(f"r.{c}").alias(c) for c in [*order, *rest]])


def judge_key(chunk: Column, question: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", chunk, norm(question)), 256), 1, 20)


def keep_by_judge(pairs: DataFrame, verdicts: DataFrame, key: str, least: int = 4, task="task", answer="answer") -> DataFrame:
    """Pairs whose verdict is good; unanswerable and abstaining ones stay without one."""
    v = verdicts.select(F.col(key).alias("_k"), F.col("correct").alias("_correct"), F.col("grounded").alias("_grounded"))
    free = F.col(task).eqNullSafe("unanswerable") | (F.trim(text_or_empty(F.col(answer))) == ABSTAIN)
    good = F.coalesce((F.col("_correct") >= least) & F.col("_grounded"), F.lit(False))
    return pairs.join(v, pairs[key] == F.col("_k"), "left").where(free | good).drop("_k", "_correct", "_grounded")


def pref_clean(chosen: Column, rejected: Column, least: int = 8) -> Column:
    return (F.length(F.trim(text_or_empty(chosen))) >= least) & (F.length(F.trim(text_or_empty(rejected))) >= least) & (norm(chosen) != norm(rejected))


def last_write_wins(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The latest row of each key; sums within tasks come before the shuffle, so a busy key is no burden."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def without_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done.select(*keys), keys, "left_anti")


def blind_verdicts(prompts: DataFrame, seed: int) -> DataFrame:
    """prompt_id, chosen_wins, margin of a stand-in judge that sees the sides swapped by a hash and names the better side."""
    h = lambda n: hash_order(n, F.col("prompt_id"))
    swapped = h(seed) % 2 == 0
    better = F.when((h(6) % 4 != 0) == swapped, F.lit("B")).otherwise(F.lit("A"))
    return prompts.select("prompt_id", (better == F.when(swapped, F.lit("B")).otherwise(F.lit("A"))).alias("chosen_wins"), (h(5) % 3 + 2).cast("int").alias("margin"))


def keep_pref(raw: DataFrame, verdicts: DataFrame, least: int = 3, key: str = "prompt_id") -> DataFrame:
    """Preferences that the judge confirmed by a margin of `least` or more, with the margin."""
    return raw.join(verdicts.where(F.col("chosen_wins") & (F.col("margin") >= least)).select(key, "margin"), key)


def without_sibling(files: DataFrame, key: str, better: Column) -> DataFrame:
    """Rows of a key that has a better one go, the better ones stay."""
    have = files.where(better).select(F.col(key).alias("sibling_of")).distinct()
    return files.where(better).unionByName(files.where(~better).join(have, F.col(key) == F.col("sibling_of"), "left_anti"))
