"""Queries over files: tables written in the formats that pipelines leave behind, and read back.

Each writes the whole of its table into a new folder of the shared one, torn lines and blanks among it where the format
has to stand them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..operators import assemble as A
from ..operators import gauntlet
from ..sources import files, providers
from ..sources import tables as S
from .registry import hash_sql, query

_S = f"with {S.SQL_SCORES}"


@query(f"""with d as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as line_no, {S.SQL_NORM.format("text")} as t from documents where source is not null)
    select source, line_no, doc_id, sha256(t) as text_hash from d where t <> ''""")
def scan_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of text shards, one file a source here, read back with their line numbers; blank lines count but are no documents."""
    folder = files.shared_folder(spark, "shards")
    d = S.corpus(spark, sf_dir).where("source is not null").select("source", "doc_id", T.norm(F.col("text")).alias("t"))
    line = F.when(F.col("t") == "", F.lit("")).otherwise(F.concat_ws("\t", F.col("doc_id").cast("string"), "t"))
    d.repartition("source").sortWithinPartitions("source", "doc_id").select("source", line.alias("value")).write.partitionBy("source").text(folder)
    got = files.shard_lines(spark, folder)
    source = F.regexp_extract("file", "source=([^/]+)/", 1)
    return got.select(source.alias("source"), "line_no", F.substring_index("text", "\t", 1).cast("long").alias("doc_id"), F.sha2(F.expr("substring(text, instr(text, '\t') + 1)"), 256).alias("text_hash"))


_KEPT = "conversations where conv_id % 50 <> 0 and conv_id % 51 <> 1"


@query(f"select conv_id, count(*) as turns, sum(length(text))::bigint as chars, count(*) filter (where role = 'user') as user_turns from {_KEPT} group by conv_id")
def scan_jsonl_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as JSON lines, some torn as by a killed writer, some blank: what can be read."""
    got = files.json_lines(spark, _torn(spark, sf_dir), "conv_id long, turn long, role string, text string")
    return got.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("role") == "user").alias("user_turns"))


@query("select count(*) as torn, count(distinct conv_id) as chats from conversations where conv_id % 50 = 0 and conv_id % 51 <> 1")
def torn_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What could not be read, counted."""
    lost = files.torn_lines(spark, _torn(spark, sf_dir), "conv_id long, turn long, role string, text string")
    return lost.agg(F.count("*").alias("torn"), F.count_distinct(F.regexp_extract("value", '"conv_id":([0-9]+)', 1)).alias("chats"))


def _torn(spark: SparkSession, sf_dir: str) -> str:
    folder = files.shared_folder(spark, "torn")
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    torn = F.when(F.col("conv_id") % 51 == 1, F.lit("  ")).when(F.col("conv_id") % 50 == 0, F.expr("substring(line, 1, length(line) - 5)")).otherwise(F.col("line"))
    S.table(spark, sf_dir, "conversations").withColumn("line", line).select(torn.alias("value")).write.text(folder)
    return folder


@query(f"""with {S.SQL_PAIRS} select id::varchar as pair_id, sha256(case when task = 'qa' then 'Context:' || chr(10) || passage || chr(10) || chr(10) || 'Question: ' || question else question end) as user_hash, answer, task,
    case when task = 'qa' then 'grounded' when task = 'unanswerable' then 'closed_book' else 'aux' end as mode from pairs""")
def chat_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grounded, closed-book and auxiliary triples, put together, written as JSON lines and read strictly."""
    folder = files.shared_folder(spark, "chat")
    p = S.pairs(spark, sf_dir)
    meta = lambda mode: F.struct("task", F.lit(mode).alias("mode"), "source", "difficulty", "chunk_id", "doc_id", F.lit(None).cast("boolean").alias("golden_present"), F.lit(None).cast("boolean").alias("answerable"), F.col("id").cast("string").alias("pair_id"), F.lit(None).cast("string").alias("cond")).alias("meta")
    part = lambda cond, system, user, mode: p.where(cond).select(A.chat(F.lit(system), user, F.col("answer")).alias("messages"), meta(mode))
    grounded = part("task = 'qa'", A.SYS_GROUNDED, A.grounded_user(F.col("passage"), F.col("question")), "grounded")
    closed = part("task = 'unanswerable'", A.SYS_CLOSED, F.col("question"), "closed_book")
    aux = part(F.col("task").isin(*gauntlet.AUX_TASKS), A.SYS_GROUNDED, F.col("question"), "aux")
    files.to_json_lines(grounded.unionByName(closed).unionByName(aux), folder)
    got = files.json_lines(spark, folder, schemas.CHAT, strict=True)
    turn = lambda i: F.element_at("messages", i)["content"]
    return got.select("meta.pair_id", F.sha2(turn(2), 256).alias("user_hash"), turn(3).alias("answer"), "meta.task", "meta.mode")


#: Items of one evaluation document.
_ITEMS = 500
_JUDGED_VERSIONS, _PLAIN_VERSIONS = ("v1", "v2", "v3", "v6"), ("v1", "v2", "v4", "v5", "v7")


def _blobs(spark: SparkSession, sf_dir: str) -> str:
    """Evaluation documents of each version, some judged, some plain, some both."""
    folder = files.shared_folder(spark, "blobs")
    c = lambda name, kind: F.col(name).cast(kind)
    scores = F.struct(F.col("f1").alias("token_f1"), F.col("em").alias("exact_match"), "fabrication", "abstain", "false_abstain", "reward", c("words", "double").alias("resp_len_words"))
    judge = F.when(F.col("judged"), F.struct(c("correctness", "int").alias("correct"), "grounded", "matches_ref", F.lit("judge").alias("model")))
    item = F.struct("cond", c("pair_id", "string").alias("pair_id"), "source", (F.col("pair_id") % 5 != 0).alias("answerable"), F.lit("s").alias("system"), F.lit("u").alias("user"), F.lit("r").alias("ref"), F.lit("a").alias("resp"), scores.alias("scores"), judge.alias("judge"))
    plain = F.struct(*[item[f] for f in ("cond", "pair_id", "source", "answerable", "system", "user", "ref", "resp", "scores")], F.lit(None).cast(schemas.JUDGE).alias("judge"))
    s = S.scores(spark, sf_dir)
    both = s.where(F.col("version").isin(*_JUDGED_VERSIONS)).select(F.concat("version", F.lit(".judged.json")).alias("name"), "pair_id", item.alias("item"))
    both = both.unionByName(s.where(F.col("version").isin(*_PLAIN_VERSIONS)).select(F.concat("version", F.lit(".json")).alias("name"), "pair_id", plain.alias("item")))
    docs = both.groupBy("name", F.floor(F.col("pair_id") / _ITEMS).alias("part")).agg(F.collect_list("item").alias("per_item"))  # at most _ITEMS times the conditions
    docs.select("name", "per_item").write.partitionBy("name").json(folder)
    return folder


_IS_JUDGED = f"version in ({', '.join(map(repr, _JUDGED_VERSIONS))})"


@query(f"{_S} select version, {_IS_JUDGED} as judged, count(*) as n, avg(f1) as token_f1, avg(case when {_IS_JUDGED} and judged then (correctness - 1) / 4.0 end) as judge_correct, count(reward) as rewards from scores group by version")
def scan_eval_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of evaluation documents, the judged document of a version before its plain one."""
    items = _items(spark, sf_dir)
    return items.groupBy("version", "judged").agg(F.count("*").alias("n"), F.avg("scores.token_f1").alias("token_f1"), F.avg((F.col("judge.correct") - 1) / 4.0).alias("judge_correct"), F.count("scores.reward").alias("rewards"))


@query(f"{_S} select version, pair_id::varchar as pair_id, cond, correctness::integer as correct, grounded, matches_ref from scores where {_IS_JUDGED} and judged")
def scan_judged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).where(F.col("judge").isNotNull())
    return items.select("version", "pair_id", "cond", "judge.correct", "judge.grounded", "judge.matches_ref")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.eval_blobs(spark, _blobs(spark, sf_dir))


@query(f"with {S.SQL_LEDGER}, a as (select workspace, app, sum(usd) as usd from ledger group by workspace, app) select workspace, app, usd, usd / sum(usd) over (partition by workspace) as share from a")
def scan_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spending from ledger documents, one a workspace with all its apps."""
    folder = files.shared_folder(spark, "ledger")
    apps = S.ledger(spark, sf_dir).groupBy("workspace", "app").agg(F.sum("usd").alias("usd"))
    files.to_json_lines(apps.groupBy("workspace").agg(F.lit("invoice").alias("source"), F.collect_list(F.struct("app", "usd")).alias("apps")), folder)  # a row an app
    from pyspark.sql.window import Window as W

    return files.ledgers(spark, folder).withColumn("share", F.col("usd") / F.sum("usd").over(W.partitionBy("workspace")))


@query(f"{_S}, j as (select * from clean where version in ('v1', 'v2') and judged and words > 5) select version, count(*) as n, avg((correctness = greatest(1, least(5, correctness + words % 3 - 1)))::int)::double as exact from j group by version")
def scan_csv_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of grades as CSV, rows that a person left blank in it; agreement over the others."""
    folder = files.shared_folder(spark, "labels")
    s = S.clean(spark, sf_dir).where("version in ('v1', 'v2')")
    human = F.when(F.col("words") > 5, F.greatest(F.lit(1), F.least(F.lit(5), F.col("correctness") + F.col("words") % 3 - 1)).cast("string")).otherwise(F.lit(" "))
    files.to_csv(s.select("pair_id", "version", "correctness", human.alias("human"), F.when(F.col("judged"), F.lit('seen, "twice"')).otherwise(F.lit("")).alias("note")), folder, ["pair_id", "version", "correctness", "human", "note"])
    got = files.csv_rows(spark, folder, "pair_id long, version string, correctness int, human string, note string", filled=("human", "note"))
    return got.groupBy("version").agg(F.count("*").alias("n"), F.avg((F.col("human").cast("int") == F.col("correctness")).cast("double")).alias("exact"))


_PREFS = f"""{S.SQL_PAIRS}, p as (select substr(sha256({S.SQL_NORM.format("question")}), 1, 16) as prompt_id, question, passage, source, trim(answer) as chosen, trim(quote) as rejected, id from pairs where task = 'qa'),
    raw as (select *, row_number() over (partition by prompt_id order by id) as k from p where length(chosen) >= 8 and length(rejected) >= 8 and {S.SQL_NORM.format("chosen")} <> {S.SQL_NORM.format("rejected")}),
    v as (select *, {hash_sql(1337, "prompt_id")} % 2 = 0 as swapped, {hash_sql(5, "prompt_id")} % 3 as m from raw where k = 1),
    j as (select *, case when ({hash_sql(6, "prompt_id")} % 4 <> 0) = swapped then 'B' else 'A' end = case when swapped then 'B' else 'A' end as chosen_wins, m + 2 as margin from v)"""


@query(f"with {_PREFS} select prompt_id, source, margin::integer as judge_margin, sha256('Context:' || chr(10) || passage || chr(10) || chr(10) || 'Question: ' || question) as user_hash, chosen, rejected from j where chosen_wins and margin >= 3")
def preference_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference triplets from log to log: clean raw pairs once a prompt, a blind verdict decoded, confirmed ones rendered, written and read."""
    raw_folder, verdict_folder, out = (files.shared_folder(spark, n) for n in ("raw-prefs", "pref-verdicts", "prefs"))
    p = S.pairs(spark, sf_dir).where("task = 'qa'").select("id", F.substring(F.sha2(T.norm(F.col("question")), 256), 1, 16).alias("prompt_id"), "question", "passage", "source", F.trim("answer").alias("chosen"), F.trim("quote").alias("rejected"))
    p = p.where(gauntlet.pref_clean(F.col("chosen"), F.col("rejected")))
    first = p.groupBy("prompt_id").agg(F.min_by(F.struct("question", "passage", "source", "chosen", "rejected"), "id").alias("r")).select("prompt_id", "r.*")
    files.to_json_lines(first, raw_folder)
    raw = files.json_lines(spark, raw_folder, schemas.RAW_PREF)
    files.to_json_lines(gauntlet.blind_verdicts(raw.select("prompt_id"), 1337), verdict_folder)
    kept = gauntlet.keep_pref(raw, files.json_lines(spark, verdict_folder, schemas.PREF_VERDICT))
    files.to_json_lines(A.preference(kept), out)
    got = files.json_lines(spark, out, schemas.PREF, strict=True)
    return got.select("meta.prompt_id", "meta.source", "meta.judge_margin", F.sha2(F.element_at("prompt", 2)["content"], 256).alias("user_hash"), "chosen", "rejected")


@query(f"{_S} select version, cond, count(*) as n from scores group by version, cond")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written as CSV in a fixed order of columns, read back and counted."""
    folder = files.shared_folder(spark, "csv")
    files.to_csv(S.scores(spark, sf_dir), folder, ["version", "cond", "pair_id", "f1"])
    got = files.csv_rows(spark, folder, "version string, cond string, pair_id long, f1 double")
    return got.groupBy("version", "cond").agg(F.count("*").alias("n"))


@query("""with r as (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as answer, lead(role) over (partition by conv_id order by turn) as next, role from conversations)
    select conv_id::varchar || ':' || turn as chunk_id, text as question, answer, case when turn % 3 = 0 then 'hard' else 'medium' end as difficulty from r where role = 'user' and next = 'assistant' and conv_id % 7 <> 0""")
def replies_to_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pairs from replies of a model in JSON, one to a prompt; replies are looked up in a table, some prompts have none."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    c = S.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("answer"), F.lead("role").over(w).alias("next")).where("role = 'user' and next = 'assistant'")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    hard = F.when(F.col("turn") % 3 == 0, F.lit("hard"))
    replies = c.where("conv_id % 7 <> 0").select(key.alias("key"), F.to_json(F.array(F.struct(F.col("text").alias("question"), "answer", hard.alias("difficulty")))).alias("reply"))
    chunks = c.select(key.alias("key"), key.alias("chunk_id"), F.col("conv_id").cast("string").alias("doc_id"), F.lit("chat").alias("source"), F.lit("qa").alias("task"), F.col("text"))
    log = spark.createDataFrame([], "key string, reply string, seq long")
    got = providers.ask(chunks.select("key", F.col("text").alias("prompt")), providers.table_provider(replies), log)
    return providers.records(chunks, got, T.ABSTAIN).select("chunk_id", "question", "answer", "difficulty")
