"""Queries of score summaries, statistics, ledgers and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import hash_order
from ..operators import gauntlet, sampling, stats
from ..sources import files
from ..sources import tables as S
from ..sources.files import shared_folder
from ..streaming import logs
from .registry import hash_sql, query

_S = f"with {S.SQL_SCORES}"


@query(f"{_S} select version, source, avg(correctness)::double as mean_score, avg(grounded::int)::double * 100 as grounded_pct, count(*) as n from clean group by version, source")
def score_summary_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.clean(spark, sf_dir).groupBy("version", "source").agg(F.avg("correctness").alias("mean_score"), (F.avg(F.col("grounded").cast("double")) * 100).alias("grounded_pct"), F.count("*").alias("n"))


_MEASURES = {"token_f1": "f1", "exact_match": "em", "fabrication": "fabrication", "abstain_rate": "abstain", "false_abstain_rate": "false_abstain", "reward": "reward"}


@query(f"{_S} select version, cond, count(*) as n, {', '.join(f'avg({c}) as {m}' for m, c in _MEASURES.items())} from scores group by version, cond")
def cond_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of five measures and the reward (null without any) by version and condition."""
    return S.scores(spark, sf_dir).groupBy("version", "cond").agg(F.count("*").alias("n"), *[F.avg(c).alias(m) for m, c in _MEASURES.items()])


@query(None)
def cond_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with 95 % bootstrap intervals, a row a measure."""
    s = S.scores(spark, sf_dir).select("version", "cond", *[F.col(c).alias(m) for m, c in _MEASURES.items()])
    long = s.unpivot(["version", "cond"], list(_MEASURES), "metric", "value").where("value is not null")
    return stats.bootstrap_ci(long, ["version", "cond", "metric"], "value", seed=0)


_ON = "avg(f1) filter (where cond = '{0}')"


@query(f"""{_S}, g as (select version, {_ON.format('clean')} as clean, {_ON.format('realistic')} as realistic, {_ON.format('closed_book')} as closed, avg(abstain) filter (where cond = 'retrieval_failure') as correct_abstention from scores group by version)
    select version, realistic - closed as grounding_gap, clean - realistic as distractor_gap, correct_abstention, closed >= clean - 0.05 as memorised from g""")
def raft_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the right document adds, what distractors take, abstention where nothing was retrieved, and whether a version seems to know the answers by heart."""
    on = lambda c, v="f1": F.avg(F.when(F.col("cond") == c, F.col(v)))
    g = S.scores(spark, sf_dir).groupBy("version").agg(on("clean").alias("clean"), on("realistic").alias("realistic"), on("closed_book").alias("closed"), on("retrieval_failure", "abstain").alias("correct_abstention"))
    return g.select("version", (F.col("realistic") - F.col("closed")).alias("grounding_gap"), (F.col("clean") - F.col("realistic")).alias("distractor_gap"), "correct_abstention", (F.col("closed") >= F.col("clean") - 0.05).alias("memorised"))


@query(None)
def paired_gap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two gaps of a version over items that both conditions have, with intervals."""
    s = S.scores(spark, sf_dir).select("version", "pair_id", "cond", "f1")
    of = lambda cond, name: s.where(F.col("cond") == cond).select("version", "pair_id", F.col("f1").alias(name))
    gap = lambda a, b, name: of(a, "x").join(of(b, "y"), ["version", "pair_id"]).select("version", F.lit(name).alias("gap"), (F.col("x") - F.col("y")).alias("diff"))
    both = gap("realistic", "closed_book", "grounding").unionByName(gap("clean", "realistic", "distractor"))
    return stats.bootstrap_ci(both, ["version", "gap"], "diff", seed=0).withColumn("significant", stats.significant(F.col("lo"), F.col("hi")))


_TOTAL = "least(5, greatest(0, correctness)) + least(2, greatest(0, completeness)) + least(2, greatest(0, groundedness)) + least(1, greatest(0, clarity))"
_PARTS = "greatest(0, least(5, correctness)) as correctness, greatest(0, least(2, completeness)) as completeness, greatest(0, least(2, groundedness)) as groundedness, greatest(0, least(1, clarity)) as clarity"


@query(f"""{_S}, {S.SQL_VERSIONS} select c.version as model, v.family as size, v.stage, c.pair_id as question_id, c.source, {_PARTS}, {_TOTAL} as total, greatest(0, least(2, groundedness)) = 2 as grounded, fabrication > 0 as fabricated,
    o.o_orderpriority as question, repeat('w ', words::integer) as answer_text, o.o_orderstatus as gold_text
    from clean c join versions v using (version) join orders o on o.o_orderkey = c.pair_id where judged""")
def p0_master_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the clean condition with their rubric scores, exploded from a map by model, as fifteen flat columns."""
    s = S.clean(spark, sf_dir)
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("gold_text"))
    items = s.select(F.col("version").alias("model"), F.col("pair_id").alias("question_id"), "source", (F.col("fabrication") > 0).alias("fabricated"), F.repeat(F.lit("w "), F.col("words").cast("int")).alias("answer_text")).join(o, "question_id")
    graded = s.where("judged").groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct("version", S.rubric()))).alias("graded"))  # one entry a version
    flat = graded.select(F.col("pair_id").alias("question_id"), F.explode("graded").alias("model", "g"))
    meta = F.broadcast(S.versions(spark).select(F.col("version").alias("model"), F.col("family").alias("size"), "stage"))
    parts = [F.col(f"g.parts.{c}").alias(c) for c in ("correctness", "completeness", "groundedness", "clarity")]
    rows = items.join(flat, ["question_id", "model"]).join(meta, "model")
    return rows.select("model", "size", "stage", "question_id", "source", *parts, F.col("g.score").alias("total"), F.col("g.grounded").alias("grounded"), "fabricated", "question", "answer_text", "gold_text")


_ITEM = {"judge_correct": "case when judged then (correctness - 1) / 4.0 end", "grounded": "case when judged then grounded::int end", "matches_ref": "case when judged then matches_ref::int end", "token_f1": "f1", "exact_match": "em", "fabrication": "fabrication", "false_abstain": "false_abstain", "reward": "reward", "resp_len_words": "words"}


@query(f"{_S}, long as ({' union all '.join(f'select version, {chr(39)}{m}{chr(39)} as metric, ({c})::double as value from clean' for m, c in _ITEM.items())}) select version, metric, count(value) as n, avg(value) as mean, min(value) as least, max(value) as most from long where value is not null group by version, metric")
def item_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as rows; what the judge did not grade, or a reward that is missing, doesn't count."""
    if_judged = lambda c: F.when(F.col("judged"), c.cast("double"))
    values = {"judge_correct": if_judged((F.col("correctness") - 1) / 4.0), "grounded": if_judged(F.col("grounded").cast("int")), "matches_ref": if_judged(F.col("matches_ref").cast("int")), "token_f1": F.col("f1"), "exact_match": F.col("em"), "fabrication": F.col("fabrication"), "false_abstain": F.col("false_abstain"), "reward": F.col("reward"), "resp_len_words": F.col("words").cast("double")}
    s = S.clean(spark, sf_dir).select("version", *[c.alias(m) for m, c in values.items()])
    long = s.unpivot(["version"], list(values), "metric", "value").where("value is not null")
    return long.groupBy("version", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


@query(f"{_S} select version, count(*) as n, round(avg((correctness - 1) / 4.0), 3) as correct01, round(avg(grounded::int) * 100, 1) as grounded, round(avg(f1), 3) as token_f1, round(avg((fabrication > 0)::int) * 100, 1) as fabrication from clean where judged group by version")
def cards_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of a model card."""
    share = lambda c: F.round(F.avg(c.cast("double")) * 100, 1)
    return S.clean(spark, sf_dir).where("judged").groupBy("version").agg(F.count("*").alias("n"), F.round(F.avg((F.col("correctness") - 1) / 4.0), 3).alias("correct01"), share(F.col("grounded")).alias("grounded"), F.round(F.avg("f1"), 3).alias("token_f1"), share(F.col("fabrication") > 0).alias("fabrication"))


@query(f"{_S}, {S.SQL_VERSIONS} select version, case when not reward_circular then avg(reward) end as reward, case when not reward_circular then count(reward) else 0 end as n from scores join versions using (version) group by version, reward_circular")
def reward_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reward of each version; hidden where the version was trained on that reward."""
    r = S.scores(spark, sf_dir).join(F.broadcast(S.versions(spark)), "version").groupBy("version", "reward_circular").agg(F.avg("reward").alias("r"), F.count("reward").alias("c"))
    return r.select("version", F.when(~F.col("reward_circular"), F.col("r")).alias("reward"), F.when(~F.col("reward_circular"), F.col("c")).otherwise(0).alias("n"))


_EXAMPLES = "case when not is_base and judged and correctness >= 4 and f1 < 0.2 and words >= 8 then 'under-scored' end, case when not is_base and words between 1 and 3 then 'collapse' end, case when not is_base and abstain > 0 and pair_id % 5 <> 0 then 'over-abstention' end, case when not is_base and fabrication > 0 and judged and not grounded then 'ungrounded' end"


@query(f"{_S}, {S.SQL_VERSIONS}, e as (select version, pair_id, unnest(list_filter([{_EXAMPLES}], lambda x: x is not null)) as kind from clean join versions using (version)) select kind, min(version || '|' || lpad(pair_id::varchar, 12, '0')) as first, count(*) as n from e group by kind")
def pick_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each telling pattern of answers of tuned versions the first example, by version and item, and how many there are."""
    s = S.clean(spark, sf_dir).join(F.broadcast(S.versions(spark)), "version").where("not is_base")
    tell = lambda cond, name: F.when(F.expr(cond), F.lit(name))
    kinds = F.array_compact(F.array(tell("judged and correctness >= 4 and f1 < 0.2 and words >= 8", "under-scored"), tell("words between 1 and 3", "collapse"), tell("abstain > 0 and pair_id % 5 <> 0", "over-abstention"), tell("fabrication > 0 and judged and not grounded", "ungrounded")))
    key = F.concat_ws("|", "version", F.lpad(F.col("pair_id").cast("string"), 12, "0"))
    return s.select(key.alias("key"), F.explode(kinds).alias("kind")).groupBy("kind").agg(F.min("key").alias("first"), F.count("*").alias("n"))


@query(f"{_S} select source, cond, count(*) as n, count(*) filter (where judged) as n_judged from scores group by source, cond")
def two_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scores(spark, sf_dir).groupBy("source", "cond").agg(F.count("*").alias("n"), F.count_if("judged").alias("n_judged"))


_MEANS = "m as (select version, avg(f1) as mean, row_number() over (order by avg(f1) desc, version) as rank from clean group by version)"


@query(f"""{_S}, {_MEANS}, d as (select a.version as a, b.version as b, x.f1 - y.f1 as diff from m a join m b on a.rank < b.rank join clean x on x.version = a.version join clean y on y.version = b.version and y.pair_id = x.pair_id)
    select a, b, count(*) as n, avg(diff) as delta from d group by a, b""")
def rank_matrix_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean paired difference of every two versions, the better ranked first."""
    s = S.clean(spark, sf_dir).select("version", "pair_id", "f1")
    ranked = stats.ranked_means(s, value="f1")
    pairs = stats.row_pairs(ranked.select("rank", "version"), [F.col("rank")]).select(F.col("a.version").alias("a"), F.col("b.version").alias("b"))
    x = s.select(F.col("version").alias("a"), "pair_id", F.col("f1").alias("x"))
    y = s.select(F.col("version").alias("b"), "pair_id", F.col("f1").alias("y"))
    return x.join(F.broadcast(pairs), "a").join(y, ["b", "pair_id"]).groupBy("a", "b").agg(F.count("*").alias("n"), F.avg(F.col("x") - F.col("y")).alias("delta"))


@query(f"{_S}, {_MEANS} select version, rank::integer as rank, mean, lead(version) over (order by rank) as next_version, mean - lead(mean) over (order by rank) as lead_gap from m")
def adjacent_pairs_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stats.ranked_means(S.clean(spark, sf_dir), value="f1")
    w = W.orderBy("rank")  # one row a version
    return r.select("version", "rank", "mean", F.lead("version").over(w).alias("next_version"), (F.col("mean") - F.lead("mean").over(w)).alias("lead_gap"))


@query(None)
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean F1 of each version over all items, with the interval of 5,000 replicates."""
    return stats.bootstrap_ci(S.clean(spark, sf_dir), ["version"], "f1", seed=0)


@query(None)
def paired_delta_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two versions in the order of their means: the mean difference over the items of both, with its interval."""
    s = S.clean(spark, sf_dir).select("version", "pair_id", "f1")
    ranked = stats.ranked_means(s, value="f1")
    pairs = stats.row_pairs(ranked.select("rank", "version"), [F.col("rank")]).select(F.col("a.version").alias("a"), F.col("b.version").alias("b"))
    x = s.select(F.col("version").alias("a"), "pair_id", F.col("f1").alias("x"))
    y = s.select(F.col("version").alias("b"), "pair_id", F.col("f1").alias("y"))
    d = x.join(F.broadcast(pairs), "a").join(y, ["b", "pair_id"]).select("a", "b", (F.col("x") - F.col("y")).alias("diff"))
    return stats.bootstrap_ci(d, ["a", "b"], "diff", seed=0).withColumn("significant", stats.significant(F.col("lo"), F.col("hi")))


_ADJ = """d as (select a.version || '-' || b.version as test, x.correctness - y.correctness as diff from (values ('v1'), ('v2'), ('v3'), ('v4'), ('v5'), ('v6')) a(version) join (values ('v2'), ('v3'), ('v4'), ('v5'), ('v6'), ('v7')) b(version) on substr(b.version, 2)::int = substr(a.version, 2)::int + 1
    join clean x on x.version = a.version join clean y on y.version = b.version and x.pair_id = y.pair_id),
    z as (select test, diff, abs(diff) as a from d where diff <> 0),
    r as (select test, diff, a, rank() over (partition by test order by a) + (count(*) over (partition by test, a) - 1) / 2.0 as r, count(*) over (partition by test, a) as t from z),
    w as (select test, count(*) as n, sum(case when diff > 0 then r else 0 end)::double as w_plus, sum(case when diff < 0 then r else 0 end)::double as w_minus, sum(t * t - 1)::double as ties from r group by test)"""


def _adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.clean(spark, sf_dir)
    nearest = s.select("version", "pair_id", "correctness")
    other = nearest.select((F.substring("version", 2, 9).cast("int") - 1).alias("before"), "pair_id", F.col("version").alias("next"), F.col("correctness").alias("y"))
    met = nearest.join(other, (F.substring(nearest["version"], 2, 9).cast("int") == F.col("before")) & (nearest["pair_id"] == other["pair_id"]))
    return met.select(F.concat_ws("-", "version", "next").alias("test"), (F.col("correctness") - F.col("y")).alias("diff"))


@query(f"{_S}, {_ADJ} select test, n, w_plus, w_minus, least(w_plus, w_minus) as w, (least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n::double * (n + 1) * (2 * n + 1) / 24 - ties / 48) as z from w")
def signed_rank_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilcoxon's signed ranks of neighbouring versions."""
    return stats.signed_rank(_adjacent(spark, sf_dir), ["test"]).select("test", "n", "w_plus", "w_minus", "w", "z")


@query(None)
def signed_rank_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tests with two-sided p and Holm's correction over them."""
    w = stats.signed_rank(_adjacent(spark, sf_dir), ["test"])
    return stats.holm(w.select("test", "n", "w", stats.two_sided_p(F.coalesce("z", F.lit(0.0))).alias("p")))


@query("with t as (select l_shipmode0 as test, p from (select 't' || l_linenumber as l_shipmode0, avg(l_discount) as p from lineitem group by l_linenumber)) select test, p, least(1.0, p * (count(*) over () - row_number() over (order by p, test) + 1)) as p_holm from t")
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("test")).agg(F.avg("l_discount").alias("p"))
    return stats.holm(t)


@query(f"{_S} select x.source, count(*) filter (where x.grounded and not y.grounded) as b, count(*) filter (where not x.grounded and y.grounded) as c from clean x join clean y on x.pair_id = y.pair_id and x.version = 'v1' and y.version = 'v2' group by x.source")
def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.clean(spark, sf_dir)
    x, y = s.where("version = 'v1'").select("pair_id", "source", F.col("grounded").alias("x")), s.where("version = 'v2'").select("pair_id", F.col("grounded").alias("y"))
    return x.join(y, "pair_id").groupBy("source").agg(*stats.discordant(F.col("x"), F.col("y")))


@query(None)
def mcnemar_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with p: exact for few discordant pairs, else chi square with continuity correction."""
    return mcnemar_counts(spark, sf_dir).withColumn("p", stats.mcnemar_test(F.col("b"), F.col("c")))


@query(f"{_S}, r as (select version, rank() over (partition by version order by f1) + (count(*) over (partition by version, f1) - 1) / 2.0 as a, rank() over (partition by version order by correctness) + (count(*) over (partition by version, correctness) - 1) / 2.0 as b, f1, correctness from clean) select version, corr(a, b) as spearman, corr(f1, correctness) as pearson from r group by version")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank and plain correlation of two metrics."""
    s = S.clean(spark, sf_dir).select("version", F.col("f1").alias("x"), F.col("correctness").cast("double").alias("y"))
    return stats.correlations(s, ["version"], "x", "y")


@query("""with m as (select n_regionkey * 100 + n_nationkey as k, avg(c_acctbal) as x, count(*)::double as y from customer join nation on c_nationkey = n_nationkey group by 1)
    select sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(count(*) filter (where a.x <> b.x)::double * count(*) filter (where a.y <> b.y)) as tau_b, count(*) as n_pairs from m a join m b on a.k < b.k""")
def kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tau-b of two orders of the nations."""
    n = S.table(spark, sf_dir, "nation")
    c = S.table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    m = c.groupBy((F.col("n_regionkey") * 100 + F.col("n_nationkey")).alias("k")).agg(F.avg("c_acctbal").alias("x"), F.count("*").cast("double").alias("y"))
    return stats.kendall_tau_b(m, "k", "x", "y")


_TWO = "g as (select x.source, x.correctness as a, y.correctness as b from clean x join clean y on x.pair_id = y.pair_id and x.version = 'v1' and y.version = 'v2')"


@query(f"""{_S}, {_TWO}, o as (select a as i, b as j, count(*)::double as o from g group by 1, 2), r as (select i, sum(o) as r from o group by 1), c as (select j, sum(o) as c from o group by 1), n as (select sum(o) as n from o)
    select 1 - sum((r.i - c.j) * (r.i - c.j) * coalesce(o.o, 0)) / sum((r.i - c.j) * (r.i - c.j) * r.r * c.c / n.n) as kappa, (any_value(n.n))::bigint as n from r cross join c cross join n left join o on o.i = r.i and o.j = c.j""")
def weighted_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.weighted_kappa(_graded(spark, sf_dir), "a", "b")


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.clean(spark, sf_dir)
    x, y = s.where("version = 'v1'").select("pair_id", "source", F.col("correctness").alias("a")), s.where("version = 'v2'").select("pair_id", F.col("correctness").alias("b"))
    return x.join(y, "pair_id")


@query(f"""{_S}, {_TWO}, p as (select source, count(*)::double as n, avg((a = b)::int) as exact, avg((abs(a - b) <= 1)::int) as within_1, avg(abs(a - b)) as mae, avg(((a >= 4) = (b >= 4))::int) as po, avg((a >= 4)::int) as pa, avg((b >= 4)::int) as pb from g group by source)
    select source, exact, within_1, mae::double as mae, po as binary_agree, case when pa * pb + (1 - pa) * (1 - pb) = 1 then 1.0 else (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) end as kappa from p""")
def agreement_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two graders, and Cohen's kappa of good against not."""
    a, b = F.col("a"), F.col("b")
    yes = lambda c: F.avg(c.cast("double"))
    p = _graded(spark, sf_dir).groupBy("source").agg(yes(a == b).alias("exact"), yes(F.abs(a - b) <= 1).alias("within_1"), F.avg(F.abs(a - b)).alias("mae"), yes((a >= 4) == (b >= 4)).alias("binary_agree"), yes(a >= 4).alias("pa"), yes(b >= 4).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return p.select("source", "exact", "within_1", "mae", "binary_agree", F.when(pe == 1, 1.0).otherwise((F.col("binary_agree") - pe) / (1 - pe)).alias("kappa"))


@query(f"{_S} select version, avg(((f1 > 0.5) <> ((correctness - 1) / 4.0 > 0.5))::int)::double as disagree from clean group by version")
def f1_judge_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = (F.col("f1") > 0.5) != ((F.col("correctness") - 1) / 4.0 > 0.5)
    return S.clean(spark, sf_dir).groupBy("version").agg(F.avg(off.cast("double")).alias("disagree"))


@query(f"{_S} select pair_id, var_pop((correctness - 1) / 4.0) as variance from clean group by pair_id having count(distinct version) = (select count(distinct version) from clean) order by round(var_pop((correctness - 1) / 4.0), 12) desc, pair_id limit 6")
def item_variance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six items on which the versions differ most, of those that all answered."""
    s = S.clean(spark, sf_dir)
    v = s.groupBy("pair_id").agg(F.var_pop((F.col("correctness") - 1) / 4.0).alias("variance"), F.count("*").alias("n"))
    return v.where(F.col("n") == stats.n_of(s, "version")).orderBy(F.desc(F.round("variance", 12)), "pair_id").limit(6).select("pair_id", "variance")


@query(f"{_S} select pair_id from clean group by pair_id having count(distinct version) = (select count(distinct version) from clean)")
def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.clean(spark, sf_dir)
    return s.groupBy("pair_id").agg(F.count("*").alias("n")).where(F.col("n") == stats.n_of(s, "version")).select("pair_id")


@query(f"{_S}, c as (select pair_id, count(*) as n from clean group by pair_id) select n, count(*) as n_questions from c group by n")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by the number of versions that have a score."""
    return S.clean(spark, sf_dir).groupBy("pair_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("n_questions"))


@query("""with n as (select source, n_chars, row_number() over (partition by source order by n_chars, doc_id) - 1 as i, count(*) over (partition by source) as c from documents)
    select source, median(n_chars)::double as median_true, max(case when i = c // 2 then n_chars end)::bigint as median_upper, max(case when i = floor(c * 0.95) then n_chars end)::bigint as p95 from n group by source""")
def medians_three_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, upper median and the value at 95 % of the places, from counts of distinct values."""
    v = S.table(spark, sf_dir, "documents").where("n_chars is not null").groupBy("source", "n_chars").agg(F.count("*").alias("c"))
    w = W.partitionBy("source")
    v = v.withColumn("upto", F.sum("c").over(w.orderBy("n_chars"))).withColumn("n", F.sum("c").over(w))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("n_chars")))
    s = v.groupBy("source").agg(at(F.floor(F.col("n") / 2)).alias("median_upper"), at(F.floor((F.col("n") - 1) / 2)).alias("lower"), at(F.floor(F.col("n") * 0.95)).alias("p95"))
    return s.select("source", ((F.col("lower") + F.col("median_upper")) / 2).alias("median_true"), "median_upper", "p95")


@query(f"with {S.SQL_LEDGER}, w as (select workspace, sum(usd) as usd, count(*) as n, arg_max(app, (usd, app)) as top_app from ledger group by workspace) select workspace, usd, n, top_app, usd / sum(usd) over () as share from w")
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.ledger(spark, sf_dir).groupBy("workspace").agg(F.sum("usd").alias("usd"), F.count("*").alias("n"), F.max(F.struct("usd", "app"))["app"].alias("top_app"))
    return w.withColumn("share", F.col("usd") / F.sum("usd").over(W.partitionBy()))


_BUDGET = 1000.0


@query(f"with {S.SQL_LEDGER}, w as (select workspace, sum(usd) as usd from ledger where app in ('app1', 'app2', 'app3') group by workspace), t as (select workspace, sum(usd) as total from ledger group by workspace) select workspace, total, coalesce(usd, 0) as attributed, total - coalesce(usd, 0) as unattributed, total > {_BUDGET} as over_budget from t left join w using (workspace)")
def ledger_unattributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a workspace spent beyond the apps that are known."""
    known = F.col("app").isin("app1", "app2", "app3")
    w = S.ledger(spark, sf_dir).groupBy("workspace").agg(F.sum("usd").alias("total"), F.coalesce(F.sum(F.when(known, F.col("usd"))), F.lit(0.0)).alias("attributed"))
    return w.select("workspace", "total", "attributed", (F.col("total") - F.col("attributed")).alias("unattributed"), (F.col("total") > _BUDGET).alias("over_budget"))


@query(f"with {S.SQL_LEDGER}, c as (select workspace, sum(usd) as cell from ledger group by workspace), p as (select workspace, app, sum(usd) as part from ledger group by workspace, app), s as (select workspace, sum(part) as total, max(part) / sum(part) as top_share from p group by workspace) select workspace, abs(cell - total) < 0.005 as total_ok, top_share between 0 and 1 as share_ok from c join s using (workspace)")
def formula_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the ledger report against what their formulas give, within half a cent."""
    g = S.ledger(spark, sf_dir)
    cell = g.groupBy("workspace").agg(F.sum("usd").alias("cell"))
    parts = g.groupBy("workspace", "app").agg(F.sum("usd").alias("part")).groupBy("workspace").agg(F.sum("part").alias("total"), (F.max("part") / F.sum("part")).alias("top_share"))
    return cell.join(parts, "workspace").select("workspace", (F.abs(F.col("cell") - F.col("total")) < 0.005).alias("total_ok"), F.col("top_share").between(0, 1).alias("share_ok"))


@query("""select case when lower(p_name) like '%ring%' then 'jewellery' when lower(p_name) like '%widget%' or lower(p_name) like '%gear%' then 'machinery' when lower(p_type) = 'economy' then 'cheap' else 'other' end as category, count(*) as n, sum(p_retailprice) as usd from part group by 1""")
def category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by the first keyword that a name holds, in a fixed order."""
    name = F.lower("p_name")
    c = F.when(name.contains("ring"), "jewellery").when(name.contains("widget") | name.contains("gear"), "machinery").when(F.lower("p_type") == "economy", "cheap").otherwise("other")
    return S.table(spark, sf_dir, "part").groupBy(c.alias("category")).agg(F.count("*").alias("n"), F.sum("p_retailprice").alias("usd"))


@query(f"with {S.SQL_LEDGER}, p as (select case when r_name in ('ASIA', 'EUROPE') then 'training' when r_name = 'AFRICA' then 'evaluation' else 'other' end as phase, usd from ledger join nation on app = 'app' || n_nationkey join region on r_regionkey = n_regionkey) select phase, sum(usd) as usd, sum(usd) / sum(sum(usd)) over () as share from p group by phase")
def ledger_phase_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spending by phase, apps mapped to phases by a small table with a default."""
    n = S.table(spark, sf_dir, "nation").join(F.broadcast(S.table(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    phase = F.when(F.col("r_name").isin("ASIA", "EUROPE"), "training").when(F.col("r_name") == "AFRICA", "evaluation").otherwise("other")
    phases = n.select(F.concat(F.lit("app"), F.col("n_nationkey").cast("string")).alias("app"), phase.alias("phase"))
    p = S.ledger(spark, sf_dir).join(F.broadcast(phases), "app").groupBy("phase").agg(F.sum("usd").alias("usd"))
    return p.withColumn("share", F.col("usd") / F.sum("usd").over(W.partitionBy()))


@query(f"""with {S.SQL_LEDGER}, i as (select app, sum(usd) as invoiced from ledger group by app), c as (select 'app' || s_nationkey as app, sum(s_acctbal) * 12 as claimed from supplier group by s_nationkey)
    select app, claimed, invoiced, case when claimed is null then 'no cost' when invoiced is null then 'not represented' when abs(claimed - invoiced) <= 0.005 then 'matches' when claimed < invoiced then 'understated' else 'overstated' end as verdict, claimed / nullif(invoiced, 0) as ratio from i full join c using (app)""")
def ledger_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed against invoiced spending within half a cent."""
    i = S.ledger(spark, sf_dir).groupBy("app").agg(F.sum("usd").alias("invoiced"))
    c = S.table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("app"), F.col("s_nationkey").cast("string")).alias("app")).agg((F.sum("s_acctbal") * 12).alias("claimed"))
    d = F.col("claimed") - F.col("invoiced")
    verdict = F.when(F.col("claimed").isNull(), "no cost").when(F.col("invoiced").isNull(), "not represented").when(F.abs(d) <= 0.005, "matches").when(d < 0, "understated").otherwise("overstated")
    return i.join(c, "app", "full").select("app", "claimed", "invoiced", verdict.alias("verdict"), F.try_divide("claimed", "invoiced").alias("ratio"))


@query("""with r(event_type, rate_in, rate_out) as (values ('click', 0.1, 0.4), ('view', 0.25, 1.5))
    select e.event_type, count(*) as requests, count(*) filter (where value > 95) as retries, sum(user_id)::bigint as in_tokens, sum(value) as out_tokens, sum(user_id) / 1e6 * any_value(coalesce(r.rate_in, 0.1)) + sum(value) / 1e6 * any_value(coalesce(r.rate_out, 0.4)) as usd
    from events e left join r on r.event_type = e.event_type group by e.event_type""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, tokens and cost by kind, with rates of a small table and a default."""
    rates = spark.createDataFrame([("click", 0.1, 0.4), ("view", 0.25, 1.5)], "event_type string, rate_in double, rate_out double")
    u = S.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("requests"), F.count_if(F.col("value") > 95).alias("retries"), F.sum("user_id").alias("in_tokens"), F.sum("value").alias("out_tokens"))
    cost = F.col("in_tokens") / 1e6 * F.coalesce("rate_in", F.lit(0.1)) + F.col("out_tokens") / 1e6 * F.coalesce("rate_out", F.lit(0.4))
    return u.join(F.broadcast(rates), "event_type", "left").select("event_type", "requests", "retries", "in_tokens", "out_tokens", cost.alias("usd"))


_LAST = "l as (select user_id, event_type, event_id, value, row_number() over (partition by user_id, event_type order by event_id desc) as k from events)"


@query(f"with {_LAST} select user_id, event_type, event_id, value from l where k = 1")
def cache_last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return gauntlet.last_write_wins(e, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("select distinct c_custkey as user_id, t.event_type from customer cross join (select distinct event_type from events) t where (c_custkey, t.event_type) not in (select (user_id, event_type) from events)")
def resume_left_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items (user, kind) that no log row has done yet. The kinds are a handful, spread over the users as an array."""
    e = S.table(spark, sf_dir, "events")
    kinds = e.groupBy("event_type").agg(F.lit(1)).select("event_type").agg(F.collect_set("event_type").alias("kinds"))
    work = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).join(F.broadcast(kinds)).select("user_id", F.explode("kinds").alias("event_type"))
    return gauntlet.without_done(work, e, ["user_id", "event_type"])


@query(f"with {_LAST} select user_id, event_type, event_id, value from l where k = 1")
def stream_dedup_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read as a stream, its latest rows kept by key."""
    return logs.latest_from_stream(spark, f"{sf_dir}/events.parquet", ["user_id", "event_type"], "event_id", ["value"])


@query("select event_type, count(*) as n, sum(value) as total from events where event_id % 40 <> 0 group by event_type")
def stream_json_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of JSON lines, one in forty torn, streamed into another such log, in two runs of which the second finds nothing new."""
    base = shared_folder(spark, "json-log")
    e = S.table(spark, sf_dir, "events").withColumn("line", F.to_json(F.struct("event_id", "event_type", "value")))
    e.select(F.when(F.col("event_id") % 40 == 0, F.expr("substring(line, 1, 12)")).otherwise(F.col("line")).alias("value")).write.text(f"{base}/in")
    schema = "event_id long, event_type string, value double"
    for _ in range(2):
        logs.append_json(logs.json_stream(spark, f"{base}/in", schema), f"{base}/out", f"{base}/checkpoint")
    return files.json_lines(spark, f"{base}/out", schema).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("select time_bucket(interval 1 day, ts) as day, event_type, count(*) as n, sum(value) as total from events group by 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows of a day over the log as a stream (an extension)."""
    return logs.daily_from_stream(spark, f"{sf_dir}/events.parquet")


@query("""with o as (select *, row_number() over (order by event_id) - 1 as rn from events), k as (select * from o where rn % 5 = 0),
    d as (select value - coalesce(lag(value) over (partition by user_id order by event_id), value) as s from k) select count(*) as n, max(abs(s)) as max_abs, avg(s) as mean_signed, avg(abs(s)) as mean_abs, max(abs(s)) <= 0.08 as close_everywhere, abs(avg(s)) <= 0.01 as unbiased from d""")
def reward_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two score columns (here a value and the one before it) on every fifth row: largest, signed and absolute mean difference against their bounds."""
    e = S.table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.lit(0).alias("all"))
    e = sampling.ranks(e, "all", "event_id").where("(rank - 1) % 5 = 0")
    w = W.partitionBy("user_id").orderBy("event_id")
    s = F.col("value") - F.coalesce(F.lag("value").over(w), F.col("value"))
    d = e.select(s.alias("s")).agg(F.count("*").alias("n"), F.max(F.abs("s")).alias("max_abs"), F.avg("s").alias("mean_signed"), F.avg(F.abs("s")).alias("mean_abs"))
    return d.withColumn("close_everywhere", F.col("max_abs") <= 0.08).withColumn("unbiased", F.abs("mean_signed") <= 0.01)


@query(f"""{_S}, p as (select x.pair_id, case when x.correctness > y.correctness then 'A' when x.correctness < y.correctness then 'B' else 'tie' end as v1,
        case when x.clarity > y.clarity then 'A' when x.clarity < y.clarity then 'B' else 'tie' end as v2 from clean x join clean y on x.pair_id = y.pair_id and x.version = 'v1' and y.version = 'v2')
    select case when v1 = v2 and v1 = 'A' then 1 when v1 = v2 and v1 = 'B' then -1 else 0 end as net, count(*) as n from p group by 1""")
def pairwise_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two orderings of a comparison; only a verdict that both give counts."""
    s = S.clean(spark, sf_dir)
    x = s.where("version = 'v1'").select("pair_id", F.col("correctness").alias("x1"), F.col("clarity").alias("x2"))
    y = s.where("version = 'v2'").select("pair_id", F.col("correctness").alias("y1"), F.col("clarity").alias("y2"))
    one = lambda a, b: F.signum(F.col(a) - F.col(b))
    net = F.when(one("x1", "y1") == one("x2", "y2"), one("x1", "y1")).otherwise(0).cast("int")
    return x.join(y, "pair_id").groupBy(net.alias("net")).agg(F.count("*").alias("n"))


@query(None)
def pairwise_swap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the same verdicts (1 for a win of the first, -1 for a loss, 0 for a tie) with its interval, by source."""
    s = S.clean(spark, sf_dir)
    x = s.where("version = 'v1'").select("pair_id", "source", F.col("correctness").alias("x1"), F.col("clarity").alias("x2"))
    y = s.where("version = 'v2'").select("pair_id", F.col("correctness").alias("y1"), F.col("clarity").alias("y2"))
    one = lambda a, b: F.signum(F.col(a) - F.col(b))
    net = F.when(one("x1", "y1") == one("x2", "y2"), one("x1", "y1")).otherwise(0.0)
    return stats.bootstrap_ci(x.join(y, "pair_id").select("source", net.alias("net")), ["source"], "net", seed=0)


@query(f"{_S} select a.pair_id, a.correctness as first_judge, b.correctness as second_judge, a.correctness - b.correctness as diff from clean a left join clean b on b.pair_id = a.pair_id and b.version = 'v2' and b.judged where a.version = 'v1'")
def optional_second_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's first grade, and a second one where there is one."""
    s = S.clean(spark, sf_dir)
    second = s.where("version = 'v2' and judged").select("pair_id", F.col("correctness").alias("second_judge"))
    first = s.where("version = 'v1'").select("pair_id", F.col("correctness").alias("first_judge"))
    return first.join(second, "pair_id", "left").withColumn("diff", F.col("first_judge") - F.col("second_judge"))


@query(f"select event_id, ({hash_sql(9, 'event_id')} % 2 = 0) as swapped, case when value > 50 then 'A' else 'B' end as better, (({hash_sql(9, 'event_id')} % 2 = 0) = (value <= 50)) as chosen_wins from events")
def blind_swap_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides swapped by a hash; the verdict decoded back."""
    swapped = hash_order(9, F.col("event_id")) % 2 == 0
    better = F.when(F.col("value") > 50, "A").otherwise("B")
    return S.table(spark, sf_dir, "events").select("event_id", swapped.alias("swapped"), better.alias("better"), (F.when(swapped, "B").otherwise("A") == better).alias("chosen_wins"))


@query("""with z as (select event_type, avg(value) as m, stddev_samp(value) as sd from events group by event_type), a as (select e.*, (value - m) / (sd + 1e-8) as adv, exp((user_id % 11 - 5) / 10.0::double) as ratio from events e join z using (event_type))
    select event_id, -ln(1 / (1 + exp(-0.1 * (value - 50)))) as dpo, -ln(1 / (1 + exp(-(value - 50) / 10))) as bt, adv as advantage, -least(ratio * adv, greatest(0.8, least(1.2, ratio)) * adv) as ppo from a""")
def preference_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of preference training from score margins, and the clipped policy loss over advantages within a kind."""
    loss = lambda m: -F.log(1 / (1 + F.exp(-m)))
    e = S.table(spark, sf_dir, "events")
    by = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    e = e.join(F.broadcast(by), "event_type")  # a row a kind
    adv, ratio, m = (F.col("value") - F.col("m")) / (F.col("sd") + 1e-8), F.exp((F.col("user_id") % 11 - 5) / 10.0), F.col("value") - 50
    ppo = -F.least(ratio * adv, F.greatest(F.lit(0.8), F.least(F.lit(1.2), ratio)) * adv)
    return e.select("event_id", loss(m * 0.1).alias("dpo"), loss(m / 10).alias("bt"), adv.alias("advantage"), ppo.alias("ppo"))


@query("select count(distinct sha256(text)) as n_hashes, count(*) as n, count(distinct sha256(text)) = count(*) as all_distinct from benchmark")
def eval_hash_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.table(spark, sf_dir, "benchmark")
    return b.agg(F.count_distinct(F.sha2("text", 256)).alias("n_hashes"), F.count("*").alias("n")).withColumn("all_distinct", F.col("n_hashes") == F.col("n"))


@query(f"""{_S}, {S.SQL_VERSIONS}, m as (select family, stage, is_base, version, avg(f1) as mean from clean join versions using (version) group by all)
    select family, max(mean) filter (where stage = 'rlaif') - max(mean) filter (where stage = 'dpo') as delta, max(mean) filter (where not is_base) - max(mean) filter (where is_base) as lift, arg_max(version, (mean, version)) as best from m group by family""")
def delta_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By family: one way of training against the other, the lift from base to best, the best version."""
    m = S.clean(spark, sf_dir).groupBy("version").agg(F.avg("f1").alias("mean")).join(F.broadcast(S.versions(spark)), "version")
    top = lambda cond: F.max(F.when(F.expr(cond), F.col("mean")))
    return m.groupBy("family").agg((top("stage = 'rlaif'") - top("stage = 'dpo'")).alias("delta"), (top("not is_base") - top("is_base")).alias("lift"), F.max(F.struct("mean", "version"))["version"].alias("best"))


@query(f"""{_S}, {S.SQL_VERSIONS}, t as (select family, words::double as words, ({_TOTAL})::double as total from clean join versions using (version)),
    r as (select *, rank() over (order by words) + (count(*) over (partition by words) - 1) / 2.0 as rw, rank() over (order by total) + (count(*) over (partition by total) - 1) / 2.0 as rt from t)
    select corr(rw, rt) as spearman, corr(words, total) as pearson, avg(total) filter (where family = 'large') as own_mean, avg(total) filter (where family <> 'large') as others_mean from r""")
def judge_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether longer answers score more, and the judge's own family against the others. Ranks come from counts of distinct values."""
    s = S.clean(spark, sf_dir).join(F.broadcast(S.versions(spark)), "version").select("family", F.col("words").cast("double").alias("x"), S.rubric()["score"].alias("y"))
    means = s.agg(F.avg(F.when(F.col("family") == "large", F.col("y"))).alias("own_mean"), F.avg(F.when(F.col("family") != "large", F.col("y"))).alias("others_mean"))
    both = stats.correlations(s.withColumn("all", F.lit(0)), ["all"], "x", "y")
    return both.select("spearman", "pearson").join(F.broadcast(means))  # one row each


@query("select event_type, json_extract_string(props, '$.k') as k, count(*) as n from events where props is not null group by 1, 2")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a field of a JSON column."""
    e = S.table(spark, sf_dir, "events").where("props is not null")
    return e.groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))
