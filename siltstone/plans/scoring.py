"""Queries of answer metrics, example assembly and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import assemble as A
from ..operators import gauntlet, prompts, sampling
from ..sources import tables as S
from .curation import _words
from .registry import hash_sql, query

_PAIRS = f"with {S.SQL_PAIRS}"


def _counts(c: str) -> str:
    return f"map_from_entries(list_transform(list_distinct({c}), lambda x: row(x, len(list_filter({c}, lambda y: y = x)))))"


@query(f"""{_PAIRS}, w as (select id, {_words("answer")} as p, {_words("quote")} as r from pairs),
    o as (select id, p, r, coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(r, lambda y: y = x))))), 0)::double as n_both from w)
    select id, case when len(p) > 0 and len(r) > 0 and n_both > 0 then 2 * (n_both / len(p)) * (n_both / len(r)) / (n_both / len(p) + n_both / len(r)) else 0.0 end as f1,
           (array_to_string(p, ' ') = array_to_string(r, ' '))::int::double as em from o""")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of each pair's answer with its quote."""
    a, q = F.col("answer"), F.col("quote")
    return S.pairs(spark, sf_dir).select("id", T.token_f1(a, q).alias("f1"), T.exact_match(a, q).alias("em"))


def _num(x: str) -> str:
    return rf"regexp_replace(regexp_replace(replace({x}, ',', ''), '%+$', ''), '\.+$', '')"


@query(rf"""with p as (select a.doc_id, a.text as ctx, b.text as pred from documents a join documents b on b.doc_id = a.doc_id + 1),
    n as (select doc_id, list_transform(regexp_extract_all(pred, '\d[\d,\.]*'), lambda x: {_num("x")}) as np, list_transform(regexp_extract_all(ctx, '\d[\d,\.]*'), lambda x: {_num("x")}) as nc, {_num("ctx")} as whole from p)
    select doc_id, (len(list_filter(np, lambda x: x <> '' and not list_contains(nc, x) and not contains(whole, x))) > 0)::int::double as fabrication from n""")
def fabrication_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the next document states a number that a document lacks."""
    d = S.corpus(spark, sf_dir)
    p = d.select("doc_id", F.col("text").alias("ctx")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("pred")), "doc_id")
    return p.select("doc_id", T.fabrication(F.col("pred"), F.col("ctx")).alias("fabrication"))


@query(f"{_PAIRS} select task, avg((contains(lower(answer), '{T.ABSTAIN}'))::int)::double as abstain, avg((contains(lower(answer), '{T.ABSTAIN}') and task <> 'unanswerable')::int)::double as false_abstain, avg(len({S.SQL_TOKENS.format('answer')}))::double as resp_len from pairs group by task")
def abstain_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes = T.abstains(F.col("answer"))
    return S.pairs(spark, sf_dir).groupBy("task").agg(F.avg(yes.cast("double")).alias("abstain"), F.avg((yes & (F.col("task") != "unanswerable")).cast("double")).alias("false_abstain"), F.avg(T.word_count(F.col("answer"))).alias("resp_len"))


@query(f"{_PAIRS} select id, contains({S.SQL_NORM.format('passage')}, {S.SQL_NORM.format('quote')}) as ok, len(quote)::integer as quote_chars from pairs")
def quote_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pairs(spark, sf_dir).select("id", T.quote_ok(F.col("quote"), F.col("passage")).alias("ok"), F.length("quote").alias("quote_chars"))


_PART = "case when words <= 2 then 0 else greatest(0, least({1}, {0})) end"
_PARTS = {c: _PART.format(c, most) for c, most in (("correctness", 5), ("completeness", 2), ("groundedness", 2), ("clarity", 1))}


@query(f"with {S.SQL_SCORES} select version, pair_id, cond, {', '.join(f'{x} as {c}' for c, x in _PARTS.items())}, ({' + '.join(_PARTS.values())})::double as total, {_PARTS['groundedness']} = 2 as grounded, (correctness - 1) / 4.0::double as rescaled from scores")
def rubric_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rubric parts clamped to 5, 2, 2 and 1, their sum and whether the answer is grounded; answers of up to two words stand for empty ones and get nothing."""
    s = S.scores(spark, sf_dir).withColumn("r", S.rubric(F.col("words") <= 2))
    return s.select("version", "pair_id", "cond", "r.parts.correctness", "r.parts.completeness", "r.parts.groundedness", "r.parts.clarity", F.col("r.score").alias("total"), "r.grounded", ((F.col("correctness") - 1) / 4.0).alias("rescaled"))


_USER = "case id % 3 when 0 then 'Context:' || chr(10) || passage || chr(10) || chr(10) || 'Question: ' || question when 1 then 'Question: ' || question else question || ' ' || passage end"


@query(f"""{_PAIRS}, u as (select id, {_USER} as u from pairs)
    select id, trim(split_part(u, 'Question:', -1)) as question, case when instr(u, 'Question:') > 1 then trim(split_part(u, 'Question:', -1)) else trim(u) end as question_inside,
        sha256(case when contains(u, 'Question:') then left(u, len(u) - len(split_part(u, 'Question:', -1)) - 9) else '' end) as context_hash,
        case when contains(u, 'Question:') then left(trim(split_part(u, 'Question:', -1)), 130) else right(u, 130) end as shown, sha256(u) as rendered from u""")
def split_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question found again in a user turn, in the ways that the reports need: the whole turn without a mark, or also where the mark stands first; cut for show."""
    p, q, n = F.col("passage"), F.col("question"), F.col("id") % 3
    u = F.when(n == 0, A.grounded_user(p, q)).when(n == 1, F.concat(F.lit("Question: "), q)).otherwise(F.concat_ws(" ", q, p))
    d = S.pairs(spark, sf_dir).select("id", u.alias("u"))
    u, mark = F.col("u"), "Question:"
    return d.select(
        "id", T.after_last(u, mark).alias("question"), F.when(F.instr(u, mark) > 1, T.after_last(u, mark)).otherwise(F.trim(u)).alias("question_inside"), F.sha2(T.before_last(u, mark), 256).alias("context_hash"),
        F.when(F.contains(u, F.lit(mark)), F.left(T.after_last(u, mark), F.lit(130))).otherwise(F.right(u, F.lit(130))).alias("shown"), F.sha2(u, 256).alias("rendered"),
    )


@query(f"""select doc_id, sha256(case when t = '' then '(empty answer)' when len(t) > 230 then regexp_replace(substr(t, 1, 230), '\\s\\S*$', '') || ' …' else t end) as cleaned,
    sha256(regexp_replace(replace(replace(replace(replace(replace(replace(text, 'and', '**&**'), 'the', 'THE'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '\\*\\*(.+?)\\*\\*', '<strong>\\1</strong>', 'g')) as html
    from (select doc_id, text, trim(regexp_replace(regexp_replace(replace(replace(text, '{T.QUOTE_OPEN}', '“'), '{T.QUOTE_CLOSE}', '”'), '##[A-Za-z_]*quote[A-Za-z_]*##', '', 'g'), '\\s+', ' ', 'g')) as t from documents)""")
def text_clean_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return S.corpus(spark, sf_dir).select("doc_id", F.sha2(T.clean_response(t), 256).alias("cleaned"), F.sha2(T.bold_html(T.escaped(T.clean_terms(t, {"and": "**&**", "the": "THE"}))), 256).alias("html"))


_BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(rf"""with g as (select doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b-\x1f]', '', 'g'), '^{_BLANK}|{_BLANK}$', '', 'g') as t from documents),
    m as (select doc_id, t, list_max(map_values(histogram)) as most from (select doc_id, t, (select histogram(c) from (select unnest(string_split(t, '')) as c)) as histogram from g))
    select doc_id, (len(t) >= 2 and coalesce(most, 0) <= len(t) * 0.5 and (len(list_distinct(list_transform(regexp_extract_all(t, '[A-Za-z]{{2,}}'), lambda x: lower(x)))) >= 3 or (len(t) <= 50 and regexp_matches(t, '[A-Za-z0-9]')))) as gradeable from m""")
def gradeable_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.corpus(spark, sf_dir).select("doc_id", T.gradeable(F.col("text")).alias("gradeable"))


_TURNS = "m as (select conv_id, list({'role': role, 'content': text} order by turn, role, text) as ms from conversations where text is not null and role is not null group by conv_id)"


@query(f"""with {_TURNS}, r as (select conv_id, array_to_string(list_transform(ms, lambda m: '<|' || m.role || '|>' || chr(10) || m.content || '<|eos|>' || chr(10)), '') as c,
        array_to_string(list_transform(list_filter(ms, lambda m: m.role = 'system'), lambda m: m.content), chr(10) || chr(10)) as s, list_filter(ms, lambda m: m.role <> 'system') as rest from m),
    f as (select *, list_position(list_transform(rest, lambda m: m.role), 'user') as first from r)
    select conv_id, sha256(c) as custom, sha256('<bos>' || array_to_string(list_transform(rest, lambda m, i: '<start_of_turn>' || case when m.role = 'assistant' then 'model' else m.role end || chr(10)
        || case when i = first and s <> '' then s || chr(10) || chr(10) else '' end || m.content || '<end_of_turn>' || chr(10)), '')) as gemma from f""")
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.messages(spark, sf_dir)
    return m.select("conv_id", F.sha2(A.render_custom(F.col("messages")), 256).alias("custom"), F.sha2(A.render_gemma(F.col("messages")), 256).alias("gemma"))


@query(f"""with t as (select conv_id, role, len({S.SQL_TOKENS.format("text")}) + 2 as n, sum(len({S.SQL_TOKENS.format("text")}) + 2) over (partition by conv_id order by turn, role, text) as upto from conversations where text is not null and role is not null),
    k as (select conv_id, role, greatest(0, least(n, 512 - (upto - n))) as n from t)
    select conv_id, sum(n)::bigint as n_ids, sum(case when role = 'assistant' then greatest(0, n - 1) else 0 end)::bigint as n_learnt from k group by conv_id having sum(n) >= 4 and sum(case when role = 'assistant' then greatest(0, n - 1) else 0 end) > 0""")
def label_mask_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and learnt tokens of each chat cut at 512; chats with under four or nothing to learn are out."""
    mask = S.messages(spark, sf_dir).select("conv_id", A.loss_mask(F.col("messages"), T.tokens, 512).alias("mask"))
    s = mask.select("conv_id", F.size("mask").cast("long").alias("n_ids"), F.size(F.filter("mask", lambda x: x == 1)).cast("long").alias("n_learnt"))
    return s.where("n_ids >= 4 and n_learnt > 0")


@query(f"""with t as (select conv_id, role, len({S.SQL_TOKENS.format("text")}) + 2 as n from conversations where text is not null and role is not null),
    c as (select conv_id, sum(n) as n, sum(case when role = 'assistant' then n - 1 else 0 end) as learnt, sum(n) < 4 or sum(case when role = 'assistant' then n - 1 else 0 end) = 0 as dropped from t group by conv_id)
    select count(*) as chats, count(*) filter (where n > 512) as truncated, count(*) filter (where dropped) as dropped from c""")
def chat_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chats there are, how many are cut at 512 tokens, how many have nothing to learn or under four tokens."""
    mask = S.messages(spark, sf_dir).select(A.loss_mask(F.col("messages"), T.tokens, 1 << 30).alias("mask"))
    nothing = (F.size("mask") < 4) | F.forall("mask", lambda x: x == -100)
    return mask.agg(F.count("*").alias("chats"), F.count_if(F.size("mask") > 512).alias("truncated"), F.count_if(nothing).alias("dropped"))


@query(f"""with {_TURNS}, r as (select conv_id, array_to_string(list_transform(list_filter(ms, lambda m: m.role = 'system'), lambda m: m.content), chr(10) || chr(10)) as s, list_filter(ms, lambda m: m.role <> 'system') as rest from m),
    f as (select *, list_position(list_transform(rest, lambda m: m.role), 'user') as first from r),
    g as (select conv_id, '<bos>' || array_to_string(list_transform(rest, lambda m, i: '<start_of_turn>' || case when m.role = 'assistant' then 'model' else m.role end || chr(10)
        || case when i = first and s <> '' then s || chr(10) || chr(10) else '' end || m.content || '<end_of_turn>' || chr(10)), '') as t from f)
    select conv_id, len({S.SQL_TOKENS.format("t")})::integer as n_ids, len({S.SQL_TOKENS.format("split_part(t, '<start_of_turn>model' || chr(10), -1)")})::integer as n_learnt from g""")
def gemma_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of chats without a system role, and how many of them, behind the last model turn's beginning, are learnt."""
    m = S.messages(spark, sf_dir).select("conv_id", A.gemma_mask(F.col("messages"), T.tokens).alias("mask"))
    return m.select("conv_id", F.size("mask").alias("n_ids"), F.size(F.filter("mask", lambda x: x == 1)).alias("n_learnt"))


_KINDS = ("qa", "summarize", "extract", "rewrite", "unanswerable", "evolve", "judge", "pref_pair", "pref_judge", "eval_judge", "rubric", "pairwise")
_FIELDS = {"n": "5", "passage": "passage", "question": "question", "answer": "answer", "reply": "quote", "a": "answer", "b": "quote"}


@query(f"{_PAIRS} " + " union all ".join(f"select id, '{k}' as kind, sha256({prompts.sql(k, **_FIELDS)}) as prompt_hash from pairs" for k in _KINDS))
def prompt_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prompt of every pair."""
    fields = {k: F.lit(5) if k == "n" else F.col(c) for k, c in _FIELDS.items()}
    both = F.array(*[F.struct(F.lit(k).alias("kind"), F.sha2(prompts.prompt(k, **fields), 256).alias("prompt_hash")) for k in _KINDS])
    return S.pairs(spark, sf_dir).select("id", F.explode(both).alias("p")).select("id", "p.kind", "p.prompt_hash")


def ring_distractors(ring: DataFrame, asks: DataFrame, k: int = 2) -> DataFrame:
    """key, ds: for each of asks (key, own, own_doc, ap) the passages of the next k distinct texts behind place ap of a ring (p, text_key, doc, passage) that are neither its own text nor of its own document.

    Every ask looks at six followers, found by their place; those that lack a text look eight times as far, until none does."""
    n, texts = ring.agg(F.count("*"), F.countDistinct("text_key")).first()
    ask, reach, chosen = asks, min(6, n), None
    while reach > 0:
        steps = ask.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(reach)))).withColumn("p", (F.col("ap") + F.col("step")) % n)
        first = steps.join(ring.select("p", "text_key", "doc"), "p").where("text_key <> own and doc <> own_doc").groupBy("key", "text_key").agg(F.min(F.struct("step", "p")).alias("s"))
        near = F.slice(F.array_sort(F.collect_list("s")), 1, k)  # at most `reach` of them
        got = first.groupBy("key").agg(near.alias("s")).select("key", F.posexplode("s").alias("at", "s")).select("key", "at", "s.p").persist()
        whole = got.groupBy("key").count().where(F.col("count") >= min(k, texts)).select("key")
        last = reach >= n
        part = got if last else got.join(whole, "key", "left_semi")
        chosen = part if chosen is None else chosen.unionByName(part)
        ask = ask.join(whole, "key", "left_anti").persist()
        if last or ask.isEmpty():
            break
        reach = min(8 * reach, n)
    if chosen is None:
        return asks.select("key", F.array().cast("array<string>").alias("ds")).limit(0)
    named = chosen.join(ring.select("p", "passage"), "p")
    return named.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "passage"))), lambda x: x["passage"]).alias("ds"))


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The qa pairs on a ring in hashed order: their columns, p (place from 0), text_key, doc."""
    qa = S.pairs(spark, sf_dir).where("task = 'qa'").withColumn("text_key", F.sha2(T.norm(F.col("passage")), 256)).withColumn("doc", F.col("doc_id"))
    return sampling.positions(qa, T.hash_order(11, F.col("id")), "id", "p")


_RING = f"""g as (select *, {S.SQL_NORM.format("passage")} as k, row_number() over (order by {hash_sql(11, "id")}, id) - 1 as p, count(*) over () as n from pairs where task = 'qa')"""
_NEXT = """c as (select a.key, b.k, min((b.p - a.ap + n - 1) % n + 1) as step from asks a join g b on a.own <> b.k and a.own_doc <> b.doc_id group by a.key, b.k),
    t as (select key, k, step, row_number() over (partition by key order by step) as r from c), d as (select t.key, list(b.passage order by t.r) as ds from t join asks a using (key) join g b on b.p = (a.ap + t.step) % b.n where t.r <= 2 group by t.key)"""


@query(f"""with {S.SQL_PAIRS}, {_RING}, s as (select floor(floor(count(*) * 0.8) * 0.1)::bigint as absent, (floor(count(*) * 0.8) - floor(floor(count(*) * 0.8) * 0.1))::bigint as answerable, count(*) as size from g),
    u as (select *, {S.SQL_NORM.format("passage")} as k, row_number() over (order by {hash_sql(12, "id")}, id) - 1 as p from pairs where task = 'unanswerable'),
    b as (select u.* from u, s where u.p < s.absent), w as (select unnest(range(0, (select size - answerable - (select count(*) from b) from s)::bigint)) as i),
    asks as (select 'a' as part, g.id, 0 as i, 'a:' || g.id || ':0' as key, k as own, doc_id as own_doc, p as ap, question, answer, quote, passage from g, s where p < answerable
        union all select 'b', id, 0, 'b:' || id || ':0', k, doc_id, p, question, '{T.ABSTAIN}', null, passage from b
        union all select 'c', g.id, w.i, 'c:' || g.id || ':' || w.i, k, doc_id, p, question, '{T.ABSTAIN}', null, null from w, s join g on true where g.p = (s.answerable + w.i) % s.size),
    {_NEXT}, x as (select a.*, coalesce(ds, []) as ds, {hash_sql(13, "a.id")} % (len(coalesce(ds, [])) + 1) as spot from asks a left join d using (key)),
    y as (select *, case when passage is null then ds else list_concat(list_concat(ds[1:spot], [passage]), ds[spot + 1:len(ds)]) end as docs from x)
    select part, id, i::bigint as i, sha256(array_to_string(list_transform(docs, lambda t, j: '[Document ' || j || ']' || chr(10) || t), chr(10) || chr(10)) || chr(10) || chr(10) || 'Question: ' || question) as user_hash,
        sha256(case when quote is null then answer else '{T.QUOTE_OPEN} ' || quote || ' {T.QUOTE_CLOSE}' || chr(10) || answer end) as answer_hash, len(docs)::integer as n_docs, part <> 'c' as golden_present, part = 'a' as answerable from y""")
def raft_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many examples as there are qa pairs: 72 % with the golden passage among two distractors and a quoted answer, 8 % with an unanswerable question's own passage, the rest distractors alone; the last two abstain.

    Distractors are the next distinct texts of other documents on a hashed ring (knn_topk_distinct finds the nearest ones)."""
    ring = _golden(spark, sf_dir)
    size = ring.count()
    golden = int(size * 0.8)
    absent = int(golden * 0.1)
    un = S.pairs(spark, sf_dir).where("task = 'unanswerable'").withColumn("text_key", F.sha2(T.norm(F.col("passage")), 256)).withColumn("doc", F.col("doc_id"))
    un = sampling.positions(un, T.hash_order(12, F.col("id")), "id", "p").where(F.col("p") < absent)
    answerable, rest = golden - absent, size - (golden - absent) - un.count()
    turns = spark.range(rest).select(F.col("id").alias("i"), ((F.lit(answerable) + F.col("id")) % max(1, size)).alias("p"))
    none = F.lit(None).cast("string")

    def part(name: str, rows: DataFrame, answer, quote, passage) -> DataFrame:
        key = F.concat_ws(":", F.lit(name), F.col("id").cast("string"), F.col("i").cast("string"))
        return rows.select(F.lit(name).alias("part"), "id", "i", key.alias("key"), F.col("text_key").alias("own"), F.col("doc").alias("own_doc"), F.col("p").alias("ap"), "question", answer.alias("answer"), quote.alias("quote"), passage.alias("passage"))

    zero, abstain = F.lit(0).cast("long"), F.lit(T.ABSTAIN)
    asks = part("a", ring.where(F.col("p") < answerable).withColumn("i", zero), F.col("answer"), F.col("quote"), F.col("passage"))
    asks = asks.unionByName(part("b", un.withColumn("i", zero), abstain, none, F.col("passage"))).unionByName(part("c", ring.join(turns, "p"), abstain, none, none))
    full = asks.join(ring_distractors(ring, asks.select("key", "own", "own_doc", "ap")), "key", "left").withColumn("ds", F.coalesce("ds", F.array().cast("array<string>")))
    docs = F.when(F.col("passage").isNull(), F.col("ds")).otherwise(A.insert_at(F.col("ds"), T.hash_order(13, F.col("id")), F.col("passage")))
    reply = F.when(F.col("quote").isNull(), F.col("answer")).otherwise(A.quoted_answer(F.col("quote"), F.col("answer")))
    out = full.withColumn("docs", docs)
    return out.select("part", "id", "i", F.sha2(A.documents_user(F.col("docs"), F.col("question")), 256).alias("user_hash"), F.sha2(reply, 256).alias("answer_hash"), F.size("docs").alias("n_docs"), (F.col("part") != "c").alias("golden_present"), (F.col("part") == "a").alias("answerable"))


def _shown(docs: str) -> str:
    return f"array_to_string(list_transform({docs}, lambda t, j: '[Document ' || j || ']' || chr(10) || t), chr(10) || chr(10)) || chr(10) || chr(10) || 'Question: ' || question"


@query(f"""with {S.SQL_PAIRS}, {_RING}, asks as (select id::varchar as key, id, k as own, doc_id as own_doc, p as ap, question, answer, passage from g), {_NEXT},
    q as (select a.*, coalesce(ds, []) as ds from asks a left join d using (key)),
    o as (select *, list_transform(list_sort(list_transform(list_append(ds, passage), lambda t, j: {{'h': md5(id || '|' || j), 't': t}})), lambda x: x.t) as mixed from q)
    select id, cond, sha256(u) as user_hash, sha256(ref) as ref_hash from (
        select id, 'clean' as cond, {_shown("[passage]")} as u, answer as ref from o
        union all select id, 'realistic', {_shown("mixed")}, answer from o
        union all select id, 'retrieval_failure', {_shown("ds")}, '{T.ABSTAIN}' from o
        union all select id, 'closed_book', question, answer from o)""")
def eval_four_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four matched rows a pair: its passage alone, in a shuffle with two distractors, distractors alone, no document."""
    ring = _golden(spark, sf_dir)
    found = ring_distractors(ring, ring.select(F.col("id").alias("key"), F.col("text_key").alias("own"), F.col("doc").alias("own_doc"), F.col("p").alias("ap")))
    full = ring.join(found, ring["id"] == found["key"], "left").withColumn("ds", F.coalesce("ds", F.array().cast("array<string>")))
    order = F.transform(F.concat("ds", F.array("passage")), lambda t, j: F.struct(F.md5(F.concat_ws("|", F.col("id").cast("string"), (j + 1).cast("string"))).alias("h"), t.alias("t")))
    mixed = F.transform(F.array_sort(order), lambda x: x["t"])
    rows = A.four_conditions(F.col("question"), F.col("answer"), F.col("passage"), F.col("ds"), mixed)
    e = full.select("id", F.explode(rows).alias("r"))
    return e.select("id", "r.cond", F.sha2("r.user", 256).alias("user_hash"), F.sha2("r.ref", 256).alias("ref_hash"))


@query(f"""with {S.SQL_PAIRS}, q as (select id, source, row_number() over (order by {hash_sql(3, "id")}, id) - 1 as pos, count(*) over () as n from pairs where task = 'qa')
    select id, case when pos < floor(n * 0.15) and source = 'src0' then 'closed_book' else 'grounded' end as mode from q""")
def closed_book_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 15 % in hash order are closed-book where their source is src0."""
    q = S.pairs(spark, sf_dir).where("task = 'qa'").select("id", "source")
    n = q.count()
    p = sampling.positions(q, T.hash_order(3, F.col("id")), "id")
    return p.select("id", F.when((F.col("pos") < int(n * 0.15)) & (F.col("source") == "src0"), "closed_book").otherwise("grounded").alias("mode"))


@query("""with u as (select conv_id, turn, text as chosen, upper(text) || '!' as rejected from conversations where role = 'assistant' and text is not null)
    select conv_id, turn, side, len(list_filter(string_split_regex(reply, '\\s+'), lambda x: x <> ''))::integer as n_tokens from (
        select conv_id, turn, 'chosen' as side, chosen as reply from u union all select conv_id, turn, 'rejected', rejected from u)""")
def pref_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows for each preference; assistant turns and an altered form of them."""
    c = S.table(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null")
    prefs = c.select("conv_id", "turn", F.array(A.turn("system", F.lit(A.SYS_CLOSED))).alias("prompt"), F.col("text").alias("chosen"), F.concat(F.upper("text"), F.lit("!")).alias("rejected"))
    rows = A.preference_rows(prefs)
    return rows.select("conv_id", "turn", "side", T.word_count(F.element_at("messages", -1)["content"]).alias("n_tokens"))


@query("""with t as (select lang, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as n from documents)
    select lang, sum(n)::bigint as tokens, (sum(n) * 3)::bigint as trained, case when sum(n) >= 1e9 then printf('%.1fB', sum(n) / 1e9) when sum(n) >= 1e6 then printf('%.1fM', sum(n) / 1e6) when sum(n) >= 1e3 then printf('%.0fK', sum(n) / 1e3) else sum(n)::varchar end as shown from t group by lang""")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by language, times three epochs."""
    t = S.corpus(spark, sf_dir).groupBy("lang").agg(F.sum(T.word_count(F.col("text")).cast("long")).alias("tokens"))
    return t.select("lang", "tokens", (F.col("tokens") * 3).alias("trained"), T.human_count(F.col("tokens")).alias("shown"))


@query("""with p as (select page_id, regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 1) as links from pages) select page_id, unnest(links) as target from p""")
def regex_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows found by pattern in text: the link targets of a page."""
    p = S.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)">([^<]*)</a>'), F.lit(1))).alias("target"))
    return p
