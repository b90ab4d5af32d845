"""Input tables in the roles that the operators give them.

documents are the corpus; a pair of question and answer is cut from each window of each (the texts of generated pairs are inputs in
practice). labels are verdicts, conversations chats, lineitem the scores of seven versions over the same items,
customer a ledger of spending, events a log of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ABSTAIN, clamp, tokens, windows

TASKS = ("qa", "summarize", "extract", "rewrite", "unanswerable")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


#: Words of a passage; places for a document's passages in the pairs' ids.
WINDOW, PLACES = 200, 1_000_000


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair a window of WINDOW words of every document: columns of schemas.RAW_PAIR beside the number id."""
    no = F.col("no")
    d = corpus(spark, sf_dir).select("doc_id", "source", F.posexplode(windows(tokens(F.col("text")), WINDOW)).alias("no", "w"))
    task = F.element_at(F.array(*[F.lit(t) for t in TASKS]), ((F.col("doc_id") + no) % 5 + 1).cast("int"))
    d = d.withColumn("task", task).withColumn("id", F.col("doc_id") * PLACES + no)
    some = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")
    passage = F.array_join("w", " ")
    answer = F.when(F.col("task") == "unanswerable", F.lit(ABSTAIN)).when(F.col("id") % 3 == 0, F.concat_ws(" ", some(5, 8), F.lit("reason 42 elsewhere")))
    return d.select(
        "id", F.substring(F.sha2(passage, 256), 1, 16).alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "source", "task",
        F.concat(some(1, 8), F.lit("?")).alias("question"), F.coalesce(answer, some(5, 16)).alias("answer"), some(9, 6).alias("quote"),
        F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("id") % 3 + 1).cast("int")).alias("difficulty"), passage.alias("passage"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's verdict on the first pair of each labelled document."""
    good = F.col("quality") == 1
    return table(spark, sf_dir, "labels").select((F.col("doc_id") * PLACES).alias("id"), F.when(good, 5).otherwise(2).alias("correct"), good.alias("grounded"))


CONDITIONS = ("clean", "realistic", "retrieval_failure", "closed_book")
#: version, family, stage, is_base, is_raft, reward_circular
VERSIONS = (
    ("v1", "small", "base", True, False, False), ("v2", "small", "dpo", False, False, False), ("v3", "small", "rlaif", False, False, True),
    ("v4", "medium", "raft", False, True, False), ("v5", "medium", "dpo", False, False, False), ("v6", "medium", "rlaif", False, False, True),
    ("v7", "large", "sft", False, False, False),
)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored answers: the lines of an order are versions' answers, four orders in a row one item under four conditions.

    version, pair_id, cond, source; a judge's correctness 1-5, rubric parts as they came (completeness, groundedness and
    clarity may be out of range), grounded, matches_ref, judged (False: the judge gave nothing); f1, em, fabrication,
    abstain, false_abstain, reward (nullable), words."""
    li = table(spark, sf_dir, "lineitem")
    least = lambda c: F.min(c).alias(c)
    g = li.groupBy("l_orderkey", "l_linenumber").agg(*[least(c) for c in ("l_quantity", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag")])
    number = lambda c: c.cast("double")
    abstain, pair = F.col("l_suppkey") % 3 == 0, F.floor(F.col("l_orderkey") / 4).cast("long")
    words = F.col("l_quantity").cast("long")
    return g.select(
        F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("version"), pair.alias("pair_id"),
        F.element_at(F.array(*[F.lit(c) for c in CONDITIONS]), (F.col("l_orderkey") % 4 + 1).cast("int")).alias("cond"), F.col("l_returnflag").alias("source"),
        (words % 5 + 1).alias("correctness"), (F.col("l_partkey") % 4).alias("completeness"), (F.col("l_partkey") % 5 - 1).alias("groundedness"), (F.col("l_partkey") % 3).alias("clarity"),
        (F.col("l_tax") < 0.04).alias("grounded"), (words >= 25).alias("matches_ref"), (F.col("l_suppkey") % 10 != 0).alias("judged"),
        (F.col("l_discount") * 10).alias("f1"), number(F.col("l_discount") >= 0.1).alias("em"), number(F.col("l_partkey") % 7 == 0).alias("fabrication"), number(abstain).alias("abstain"),
        number(abstain & (pair % 5 != 0)).alias("false_abstain"), F.when(F.col("l_suppkey") % 4 != 0, F.col("l_tax") * 10 - 0.4).alias("reward"), words.alias("words"),
    )


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the condition by which versions are compared; one row a version and item."""
    return scores(spark, sf_dir).where("cond = 'clean'")


def rubric(empty=None):
    """A rubric record of scores(): parts clamped to their ranges, their sum, grounded; all 0 for an empty answer."""
    part = lambda c, most: F.when(F.lit(False) if empty is None else empty, 0).otherwise(clamp(F.col(c), most)).cast("long")
    parts = [part(c, most).alias(c) for c, most in (("correctness", 5), ("completeness", 2), ("groundedness", 2), ("clarity", 1))]
    total = sum(parts[1:], parts[0])
    return F.struct(total.cast("double").alias("score"), F.struct(*parts).alias("parts"), (parts[2] == 2).alias("grounded"))


def versions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VERSIONS), "version string, family string, stage string, is_base boolean, is_raft boolean, reward_circular boolean")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("workspace"), F.concat(F.lit("app"), F.col("c_nationkey").cast("string")).alias("app"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("usd"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and its turns in order; the turns of one conversation are few."""
    c = table(spark, sf_dir, "conversations").where("text is not null and role is not null")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return c.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


#: The same roles as DuckDB subqueries.
_SOME = "array_to_string(w[{0}:{1}], ' ')"
SQL_NORM = r"lower(trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g')))"
SQL_TOKENS = r"list_filter(string_split_regex(coalesce({0}, ''), '\s+'), lambda x: x <> '')"
SQL_PAIRS = f"""pairs as (
    select id0 as id, substr(sha256(passage), 1, 16) as chunk_id, doc_id::varchar as doc_id, source, task, {_SOME.format(1, 8)} || '?' as question,
           case when task = 'unanswerable' then '{ABSTAIN}' when id0 % 3 = 0 then {_SOME.format(5, 12)} || ' reason 42 elsewhere' else {_SOME.format(5, 20)} end as answer,
           {_SOME.format(9, 14)} as quote, (['easy', 'medium', 'hard'])[id0 % 3 + 1] as difficulty, passage
    from (select doc_id, source, doc_id * {PLACES} + no as id0, ws[no * {WINDOW} + 1:(no + 1) * {WINDOW}] as w, array_to_string(ws[no * {WINDOW} + 1:(no + 1) * {WINDOW}], ' ') as passage,
                 (['qa', 'summarize', 'extract', 'rewrite', 'unanswerable'])[(doc_id + no) % 5 + 1] as task
          from (select doc_id, source, ws, unnest(range(0, (len(ws) + {WINDOW - 1}) // {WINDOW})) as no from (select *, {SQL_TOKENS.format("text")} as ws from documents))))"""
SQL_VERDICTS = f"verdicts as (select doc_id * {PLACES} as id, case when quality = 1 then 5 else 2 end as correct, quality = 1 as grounded from labels)"
SQL_SCORES = """scores as (
    select 'v' || l_linenumber as version, l_orderkey // 4 as pair_id, (['clean', 'realistic', 'retrieval_failure', 'closed_book'])[l_orderkey % 4 + 1] as cond, rf as source,
           w % 5 + 1 as correctness, pk % 4 as completeness, pk % 5 - 1 as groundedness, pk % 3 as clarity, tax < 0.04 as grounded, w >= 25 as matches_ref, sk % 10 <> 0 as judged,
           disc * 10 as f1, (disc >= 0.1)::int::double as em, (pk % 7 = 0)::int::double as fabrication, (sk % 3 = 0)::int::double as abstain,
           (sk % 3 = 0 and l_orderkey // 4 % 5 <> 0)::int::double as false_abstain, case when sk % 4 <> 0 then tax * 10 - 0.4 end as reward, w as words
    from (select l_orderkey, l_linenumber, trunc(min(l_quantity))::bigint as w, min(l_partkey) as pk, min(l_suppkey) as sk, min(l_discount) as disc, min(l_tax) as tax, min(l_returnflag) as rf
          from lineitem group by l_orderkey, l_linenumber)),
    clean as (select * from scores where cond = 'clean')"""
SQL_VERSIONS = "versions(version, family, stage, is_base, is_raft, reward_circular) as (values " + ", ".join(str(v) for v in VERSIONS) + ")"
SQL_LEDGER = "ledger as (select c_mktsegment as workspace, 'app' || c_nationkey as app, greatest(c_acctbal, 0.0) as usd from customer)"
