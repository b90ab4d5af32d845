"""Queries of the corpus and the quality filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import gauntlet, sampling, similarity
from ..sources import tables as S
from ..sources.files import shared_folder
from .registry import hash_sql, query

_NORM, _TOK = S.SQL_NORM, S.SQL_TOKENS
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _content(c: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(translate({_NORM.format(c)}, ',.', '  '), ' +'), lambda x: len(x) > 2 and not list_contains({_STOP}, x)))"


def _words(c: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"


_SHARE = f"len(list_intersect(aw, pw))::double / nullif(len(aw), 0)"
_JUDGED = f"with {S.SQL_PAIRS}, {S.SQL_VERDICTS}, words as (select *, {_content('answer')} as aw, {_content('passage')} as pw, {_NORM.format('question')} || ' ' || {_NORM.format('answer')} as low from pairs)"
_RULE = f"""(len(question) >= 8 and len(answer) between 8 and 1200 and not contains(low, 'here are') and (task <> 'qa' or (
    not contains(low, 'the passage') and not contains(low, 'the text') and not contains(low, 'the document') and not contains(low, 'as stated above')
    and quote <> '' and contains({_NORM.format("passage")}, {_NORM.format("quote")}) and len({_TOK.format("quote")}) <= 60)))"""
_GROUNDED = f"(task <> 'qa' or trim(answer) = '{T.ABSTAIN}' or coalesce({_SHARE}, 0) >= 0.55)"


@query(f"""with n as (select doc_id, source, {_NORM.format("text")} as t from documents),
    r as (select source, row_number() over (partition by sha256(t) order by doc_id) as k from n)
    select source, count(*) as n_docs, count(*) filter (where k = 1) as n_kept from r group by source""")
def norm_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and first copies by source."""
    d = S.corpus(spark, sf_dir).select("doc_id", "source", F.sha2(T.norm(F.col("text")), 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"))
    kept = first.groupBy("source").agg(F.count("*").alias("n_kept"))
    return d.groupBy("source").agg(F.count("*").alias("n_docs")).join(kept, "source", "left").select("source", "n_docs", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


@query(f"""select doc_id, source || '/0:' || doc_id as chunk_doc, (i - 1)::integer as doc_chunk_no, substr(sha256(body), 1, 16) as chunk_id, body as text, n::integer as token_len
    from (select doc_id, source, i, len(w[(i - 1) * 256 + 1:i * 256]) as n, array_to_string(w[(i - 1) * 256 + 1:i * 256], ' ') as body
          from (select doc_id, source, w, unnest(range(1, least(12, (len(w) + 255) // 256) + 1)) as i from (select *, {_TOK.format("text")} as w from documents))) where n >= 80""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 256 tokens, the first 12 of a document, those under 80 tokens left out."""
    w = S.corpus(spark, sf_dir).select("doc_id", "source", T.windows(T.tokens(F.col("text")), 256).alias("w"))
    c = w.select("doc_id", "source", F.posexplode(F.slice("w", 1, 12)).alias("doc_chunk_no", "t")).where(F.size("t") >= 80)
    body = F.array_join("t", " ")
    return c.select("doc_id", F.concat("source", F.lit("/0:"), F.col("doc_id").cast("string")).alias("chunk_doc"), "doc_chunk_no", F.substring(F.sha2(body, 256), 1, 16).alias("chunk_id"), body.alias("text"), F.size("t").alias("token_len"))


@query(f"""with c as (select doc_id, source, row_number() over (partition by source order by doc_id) as k from documents where {_NORM.format("text")} <> '')
    select source, doc_id, k::integer as line_no from c""")
def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank documents numbered within their source."""
    d = S.corpus(spark, sf_dir).where(T.norm(F.col("text")) != "").select("source", "doc_id")
    return sampling.ranks(d, "source", "doc_id", "line_no").select("source", "doc_id", F.col("line_no").cast("int").alias("line_no"))


@query(f"select doc_id, array_to_string(({_TOK.format('text')})[1:64], ' ') as head from documents order by doc_id limit 1")
def scan_first_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.corpus(spark, sf_dir).orderBy("doc_id").limit(1)
    return d.select("doc_id", F.array_join(F.slice(T.tokens(F.col("text")), 1, 64), " ").alias("head"))


@query(f"select doc_id, sha256({_NORM.format('text')}) as norm_hash, len({_words('text')})::integer as n_words, len({_content('text')})::integer as n_content, len({_TOK.format('text')})::integer as n_tokens from documents")
def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, words, content words and tokens of each document."""
    t = F.col("text")
    return S.corpus(spark, sf_dir).select("doc_id", F.sha2(T.norm(t), 256).alias("norm_hash"), F.size(T.words_alnum(t)).alias("n_words"), F.size(T.content_words(t)).alias("n_content"), F.size(T.tokens(t)).alias("n_tokens"))


@query(f"""{_JUDGED} select task, count(*) as raw, count(*) filter (where {_RULE}) as after_rules, count(*) filter (where {_RULE} and {_GROUNDED}) as after_grounding from words group by task""")
def rule_filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.pairs(spark, sf_dir).select("task", gauntlet.rule_ok().alias("ok"), gauntlet.grounded_ok().alias("grounded"))
    return p.groupBy("task").agg(F.count("*").alias("raw"), F.count_if("ok").alias("after_rules"), F.count_if(F.col("ok") & F.col("grounded")).alias("after_grounding"))


@query(f"{_JUDGED} select id, {_SHARE} as share, {_GROUNDED} as grounded from words")
def content_overlap_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.pairs(spark, sf_dir)
    return p.select("id", gauntlet.overlap_share(F.col("answer"), F.col("passage")).alias("share"), gauntlet.grounded_ok().alias("grounded"))


@query(f"""with {S.SQL_PAIRS} select id, substr(sha256(chunk_id || '|' || {_NORM.format("question")}), 1, 20) as judge_key, substr(sha256({_NORM.format("question")}), 1, 16) as prompt_id,
    sha1('v1|clean|' || id || '|' || answer) as item_key, sha1('v1|v2|' || id) as cache_key, {_NORM.format("case when task in ('summarize', 'extract', 'rewrite') then answer else question end")} as signature from pairs""")
def hash_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    item = F.sha1(F.concat_ws("|", F.lit("v1"), F.lit("clean"), F.col("id").cast("string"), F.col("answer")))
    return S.pairs(spark, sf_dir).select("id", gauntlet.judge_key(F.col("chunk_id"), q).alias("judge_key"), F.substring(F.sha2(T.norm(q), 256), 1, 16).alias("prompt_id"), item.alias("item_key"), F.sha1(F.concat_ws("|", F.lit("v1"), F.lit("v2"), F.col("id").cast("string"))).alias("cache_key"), T.norm(gauntlet.signature()).alias("signature"))


@query(f"""with {S.SQL_PAIRS}, s as (select id, task, source, row_number() over (partition by sha256({_NORM.format("case when task in ('summarize', 'extract', 'rewrite') then answer else question end")}) order by id) as k from pairs)
    select id, task, source from s where k = 1""")
def signature_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pair of each task-specific signature."""
    p = S.pairs(spark, sf_dir).select("id", "task", "source", gauntlet.signature().alias("sig"))
    return gauntlet.exact_dedup(p, F.col("sig"), "id").select("id", "task", "source")


@query(f"""with {S.SQL_PAIRS}, {S.SQL_VERDICTS} select p.id, p.task, v.correct from pairs p left join verdicts v using (id)
    where p.task = 'unanswerable' or trim(p.answer) = '{T.ABSTAIN}' or (v.correct >= 4 and v.grounded)""")
def verdict_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = S.verdicts(spark, sf_dir)
    kept = gauntlet.keep_by_judge(S.pairs(spark, sf_dir).select("id", "task", "answer"), v, "id")
    return kept.join(v.select("id", "correct"), "id", "left").select("id", "task", "correct")


@query("""with u as (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as reply, role, lead(role) over (partition by conv_id order by turn) as next from conversations)
    select conv_id, turn from u where role = 'user' and next = 'assistant' and length(trim(text)) >= 8 and length(trim(reply)) >= 8 and """ + f"{_NORM.format('text')} <> {_NORM.format('reply')}")
def pref_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with a reply that both are long enough and differ."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = S.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("reply"), F.lead("role").over(w).alias("next"))
    return c.where("role = 'user' and next = 'assistant'").where(gauntlet.pref_clean(F.col("text"), F.col("reply"))).select("conv_id", "turn")


@query(f"""with w as (select {_NORM.format("text")} as t, lang from documents), k as (select lang, list_filter(string_split(t, ' '), lambda x: x <> '') as w from w),
    g as (select lang, 2 as n, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) as g from k
          union all select lang, 3, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from k)
    select lang, n, count(distinct g) as n_unique, count(*) as n_total, count(distinct g)::double / count(*) as distinct_share from g group by lang, n""")
def distinct_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct-2 and distinct-3 by language; one row a distinct gram after the partial sums, by the whole gram (SHA-256 of it in the shuffle)."""
    w = S.corpus(spark, sf_dir).select("lang", T.norm_tokens(F.col("text")).alias("w"))
    out = None
    for n in (2, 3):
        g = w.select("lang", F.explode(T.ngrams(F.col("w"), n)).alias("g")).groupBy("lang", F.unhex(F.sha2("g", 256)).alias("h")).agg(F.count("*").alias("c"))
        part = g.groupBy("lang").agg(F.lit(n).alias("n"), F.count("*").alias("n_unique"), F.sum("c").alias("n_total"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("distinct_share", F.col("n_unique") / F.col("n_total"))


@query(f"""with d as (select doc_id, list_filter(string_split({_NORM.format("text")}, ' '), lambda x: x <> '') as w from documents),
    b as (select item_id, list_filter(string_split({_NORM.format("text")}, ' '), lambda x: x <> '') as w from benchmark),
    dg as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 11, 1)), lambda i: array_to_string(w[i:i + 12], ' '))) as g from d),
    bg as (select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 11, 1)), lambda i: array_to_string(w[i:i + 12], ' '))) as g from b)
    select doc_id, item_id, count(*) as n_shared from dg join bg using (g) group by doc_id, item_id""")
def decontam_13gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a run of 13 words with a benchmark item. The benchmark's grams, a few thousand, may be broadcast by their size."""
    def grams(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.explode(F.array_distinct(T.ngrams(T.norm_tokens(F.col("text")), 13))).alias("g"))

    b = grams(S.table(spark, sf_dir, "benchmark"), "item_id")
    return grams(S.corpus(spark, sf_dir), "doc_id").join(b, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))


_SIM = "list_reduce(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double), lambda x, y: x + y)"
_EDGES = f"e as (select a.vec_id as i, b.vec_id as j, {_SIM} as sim from embeddings a join embeddings b on a.vec_id < b.vec_id where {_SIM} >= 0.4)"


@query(f"with {_EDGES} select i, j, round(sim, 6) as sim from e")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors with cosine 0.4 or more (these vectors have unit length)."""
    e = similarity.pairs_over(S.table(spark, sf_dir, "embeddings"), 0.4)
    return e.select("i", "j", F.round("sim", 6).alias("sim"))


def _greedy_sql(nodes: str, threshold: str) -> str:
    """The pass in SQL: one step a node, the kept ones in a list."""
    return f"""with recursive v as ({nodes}), e as (select a.vec_id as i, b.vec_id as j, a.n as a from v a join v b on a.n < b.n where {_SIM} >= {threshold}),
        o as (select v.vec_id, v.n, coalesce(list(e.i) filter (where e.i is not null), []) as low from v left join e on e.j = v.vec_id group by v.vec_id, v.n),
        g(n, kept) as (select 0::bigint, []::bigint[] union all select o.n, case when list_has_any(g.kept, o.low) then g.kept else list_append(g.kept, o.vec_id) end from g join o on o.n = g.n + 1)"""


@query(_greedy_sql("select *, row_number() over (order by vec_id) as n from embeddings", "0.3") + " select unnest(kept) as vec_id from g where n = (select max(n) from o)")
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that a pass in id order keeps when it drops those with cosine 0.3 or more to a kept one."""
    v = S.table(spark, sf_dir, "embeddings")
    shared_folder(spark, "greedy")  # checkpoints go to the shared folder
    edges = similarity.pairs_over(v, 0.3).select("i", "j").checkpoint()
    return similarity.greedy_keep(v.select(F.col("vec_id").alias("node")), edges).select(F.col("node").alias("vec_id"))


@query(_greedy_sql(f"select * from (select *, row_number() over (order by {hash_sql(1337, 'vec_id')}, vec_id) as n from embeddings) where n <= 300", "0.3") + " select unnest(kept[1:100]) as vec_id from g where n = (select max(n) from o)")
def greedy_dedup_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred that a pass in hashed order keeps among three times as many."""
    v = sampling.cap_shuffled(S.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 1337, 300, "vec_id")
    shared_folder(spark, "greedy")
    # The pass goes by ids, so places take the ids' part.
    order = sampling.positions(v, T.hash_order(1337, F.col("vec_id")), "vec_id", "place", parts=1).select("vec_id", F.col("place").cast("long").alias("place"), "embedding").checkpoint()
    edges = similarity.pairs_over(order, 0.3, id_col="place").select("i", "j").checkpoint()
    kept = similarity.greedy_keep(order.select(F.col("place").alias("node")), edges).orderBy("node").limit(100)
    return order.join(kept, order["place"] == kept["node"], "left_semi").select("vec_id")


@query(f"""with {_EDGES.replace("0.4", "0.2")}, u as (select i as q, j as id, sim from e union all select j, i, sim from e),
    t as (select e.vec_id as id, d.doc_id, e.label, {_NORM.format("d.text")} as k from embeddings e join documents d on d.doc_id = e.vec_id),
    c as (select u.q, u.id, round(u.sim, 6) as sim, t.k, row_number() over (partition by u.q, t.k order by round(u.sim, 6) desc, u.id) as n from u join t on t.id = u.id join t o on o.id = u.q where t.k <> o.k and t.label <> o.label),
    r as (select q, id, sim, row_number() over (partition by q order by sim desc, id) as rank from c where n = 1)
    select q, id, sim, rank from r where rank <= 2""")
def knn_topk_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector two distractors: nearest of another label with distinct texts, however far. The SQL's floor of 0.2 only keeps it short: it holds where each vector has two above."""
    v = S.table(spark, sf_dir, "embeddings")
    d = S.corpus(spark, sf_dir)
    texts = v.join(d, v["vec_id"] == d["doc_id"]).select(F.col("vec_id").alias("id"), F.unhex(F.sha2(T.norm(F.col("text")), 256)).alias("text_key"), F.col("label").alias("doc")).distinct()
    return similarity.nearest_distinct(v, texts, 2).select("q", "id", "sim", "rank")


_QA = "select id, chunk_id, source from pairs where task = 'qa'"


@query(f"""with {S.SQL_PAIRS}, q as ({_QA}), h as (select *, {hash_sql(1337, "id")} as h from q), f as (select *, row_number() over (partition by chunk_id order by h, id) as k from h)
    select id, chunk_id from f where k = 1 order by h, id limit 50""")
def carve_eval_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty qa pairs held out, one a chunk."""
    qa = S.pairs(spark, sf_dir).where("task = 'qa'").select("id", "chunk_id", "source")
    return sampling.carve_holdout(qa, 1337, 50, "chunk_id", "id").select("id", "chunk_id")


@query(f"""with {S.SQL_PAIRS}, q as ({_QA}), h as (select *, {hash_sql(1337, "id")} as h from q), f as (select *, row_number() over (partition by chunk_id order by h, id) as k from h),
    e as (select chunk_id from f where k = 1 order by h, id limit 50) select p.id, p.task from pairs p where p.chunk_id not in (select chunk_id from e)""")
def quarantine_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks that no held-out pair comes from. The fifty chunks are a bound of the holdout."""
    p = S.pairs(spark, sf_dir).select("id", "task", "chunk_id", "source")
    held = sampling.carve_holdout(p.where("task = 'qa'"), 1337, 50, "chunk_id", "id").select("chunk_id")
    return p.join(F.broadcast(held), "chunk_id", "left_anti").select("id", "task")


@query(f"""with h as (select doc_id, source, row_number() over (partition by source order by {hash_sql(7, "doc_id")}, doc_id) as turn from documents)
    select doc_id, source, turn::integer as turn from h order by turn, source limit 150""")
def stratified_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.corpus(spark, sf_dir).select("doc_id", "source")
    return sampling.stratified_round_robin(d, 7, 150, "source", "doc_id").select("doc_id", "source", "turn")


@query(f"select doc_id from documents order by {hash_sql(1337, 'doc_id')}, doc_id limit 100")
def cap_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cap_shuffled(S.corpus(spark, sf_dir).select("doc_id"), 1337, 100, "doc_id")


@query(f"""with o as (select doc_id, row_number() over (order by {hash_sql(5, "doc_id")}, doc_id) - 1 as pos from documents)
    select doc_id, pos, 'R' || lpad((pos + 1)::varchar, 6, '0') as blind_id from o""")
def blind_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under a number of its hashed place."""
    d = S.corpus(spark, sf_dir).select("doc_id")
    p = sampling.positions(d, T.hash_order(5, F.col("doc_id")), "doc_id")
    return p.select("doc_id", F.col("pos").cast("long").alias("pos"), F.format_string("R%06d", F.col("pos") + 1).alias("blind_id"))


@query(f"select lang, doc_id, n::integer as n from (select lang, doc_id, row_number() over (partition by lang order by doc_id) as n from documents) where n <= 20")
def first_n_per_cond(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_n(S.corpus(spark, sf_dir).select("lang", "doc_id"), "lang", 20, "doc_id").select("lang", "doc_id", "n")


@query("select doc_id from (select doc_id, row_number() over (order by doc_id) - 1 as n from documents) where n % 10 = 0")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document in id order; ranges of ids are counted first, so no task numbers all rows."""
    d = S.corpus(spark, sf_dir).select("doc_id", F.lit(0).alias("all"))
    return sampling.ranks(d, "all", "doc_id").where("(rank - 1) % 10 = 0").select("doc_id")


_MIX = {"src0": 1041, "src1": 1026, "src2": 933}
_OTHERS = 1000  # the mean of the mix


@query(f"""with r as (select doc_id, source, row_number() over (partition by source order by doc_id) as r, case source {' '.join(f"when '{s}' then {w}" for s, w in _MIX.items())} else {_OTHERS} end as w from documents)
    select source, doc_id, row_number() over (order by (2 * r - 1)::hugeint * ({'*'.join(map(str, [*_MIX.values(), _OTHERS]))}::hugeint // w), source nulls last) - 1 as pos from r""")
def deficit_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sources interleaved by weight, null among them. Sources outside the mix weigh as much as its mean."""
    d = S.corpus(spark, sf_dir).select("doc_id", "source")
    counts = {r.source: r["count"] for r in d.groupBy("source").count().collect()}
    ranked = sampling.ranks(d, "source", "doc_id")
    return sampling.interleaved(ranked, {s: _MIX.get(s, _OTHERS) for s in counts}, counts).select("pos", "source", "doc_id")


#: Of raft examples and of tuning examples, the share that each task's pairs make up; pairs of one call.
NEEDS = (("qa", 0.8, 0.4, 5), ("unanswerable", 0.2 + 0.8 * 0.1, 0.0, 3), ("summarize", 0.0, 0.25, 1), ("extract", 0.0, 0.2, 1), ("rewrite", 0.0, 0.15, 1))
SIZES, KEPT = {"raft": 10_000, "sft": 15_000}, 0.55
_NEEDS = f"needs(task, of_raft, of_sft, per_call) as (values {', '.join(f'({t!r}, {a!r}::double, {b!r}::double, {n})' for t, a, b, n in NEEDS)}), raw as (select task, per_call, ceil((of_raft * 10000 + of_sft * 15000) / 0.55::double)::bigint as raw_target from needs), calls as (select task, per_call, raw_target, ceil(raw_target / per_call)::bigint as calls from raw)"


def _calls(spark: SparkSession) -> DataFrame:
    return sampling.targets(spark.createDataFrame(list(NEEDS), "task string, of_raft double, of_sft double, per_call int"), SIZES, KEPT)


@query(f"with {_NEEDS} select task, per_call, raw_target, calls from calls")
def plan_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs to ask for by task, and the calls that takes."""
    return _calls(spark)


@query(f"with {_NEEDS}, e as (select task, task || '|' || i as key from (select task, unnest(range(1, calls + 1)) as i from calls)) select row_number() over (order by {hash_sql(1337, 'key')}, key) - 1 as pos, task from e")
def task_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of all tasks in one hashed order."""
    return sampling.scheduled(_calls(spark), 1337)


@query(f"with h as (select event_id, row_number() over (order by event_id) <= 60 as held_out, value > 50 as chosen_wins from events) select held_out, count(*) as n, avg(chosen_wins::int)::double as pairwise_accuracy from h group by held_out")
def rm_pairwise_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the chosen reply's reward is over the rejected one's, on the first sixty held out and on the rest; a tie is an error."""
    e = sampling.holdout(S.table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 60)
    return e.groupBy("held_out").agg(F.count("*").alias("n"), F.avg((F.col("value") > 50).cast("double")).alias("pairwise_accuracy"))
