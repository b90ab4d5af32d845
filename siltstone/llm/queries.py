"""Queries of this subpackage for __spark_entry__.py, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, jaccard, packing, secret_links, suffixes, tiff, toxicity, warc
from .common import Stash, new_folder, table
from .mixing import Mix

ROW_TOKENS = 2_048
END_OF_TEXT = 50_256


def held_out(doc_id):
    """One row in five, whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, sources weighing 3, 1, 2 in turn, at most twice each."""
    docs = table(spark, sf_dir, "documents")
    return Mix(docs, Stash(spark, "mix"), share=1.5, cap=2.0).taken()


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as .warc.zst parts and read back, equal payloads of any size kept once."""
    path = new_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path, least=0)
    got = warc.read(spark, path, payloads=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op3_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte-level BPE ids, packed into rows of 2,048 16-bit ids."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    cut = packing.pieces(table(spark, sf_dir, "documents"), ROW_TOKENS, packing.byte_pair_encoder, (path, public_tokenizers.PATTERN), END_OF_TEXT, kind="<u2")
    return packing.pack(cut, ROW_TOKENS, END_OF_TEXT, "<u2")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_features(table(spark, sf_dir, "documents"))


def op7_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.report(table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of all documents made of runs of 50 words that another document has too."""
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"), shared=50, stash=Stash(spark, "suffixes"))


def op9_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op10_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.sample(docs, table(spark, sf_dir, "labels"), held_out=held_out))
    scored = toxicity.score_column(docs, model, ("doc_id",))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_source_mix, op2_warc_zstd, op3_packed_tokens, op4_jaccard_join, op5_one_bit_neighbours, op6_tiff_pages, op7_linked_secrets, op8_repeated_passages, op9_speculative_bpe, op10_counterfactual_toxicity)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_BASE32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, i * 5 + 1, 5))::bigint // {0}) % 32 + 1)::bigint, 1)"

ORACLE_SQL = {
    "op2_warc_zstd": f"""
        with p as (select page_id, encode(coalesce(html, '')) as b, sha1(encode(coalesce(html, ''))) as h from pages),
        r as (select page_id, octet_length(b)::bigint as n, h, min(page_id) over (partition by h) as first, row_number() over (partition by h order by page_id nulls last) as nth from p)
        select page_id, n as payload_bytes,
               array_to_string(list_transform(range(0, 8), lambda i: {" || ".join(_BASE32.format(2**s) for s in (15, 10, 5, 0))}), '') as payload_digest,
               case when nth = 1 then 'response' else 'revisit' end as record_type,
               case when nth = 1 then null else first end as refers_to, cast(null as varchar) as error
        from r""",
    "op4_jaccard_join": f"""
        with recursive w as (select doc_id, {_WORDS} as w from documents),
        s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
                     else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from w),
        n as (select doc_id, len(s)::bigint as n from s),
        e as (select doc_id, unnest(s) as g from s),
        c as (select a.doc_id as a, b.doc_id as b, count(*) as both from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
        l as (select c.a, c.b from c join n x on x.doc_id = c.a join n y on y.doc_id = c.b where 100 * c.both >= 85 * (x.n + y.n - c.both)),
        r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
        select n.doc_id, n.n as n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) as component_id
        from n left join r on r.a = n.doc_id group by n.doc_id, n.n""",
    "op5_one_bit_neighbours": """
        with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
                   where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s as (select q.vec_id as query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) as score
              from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20""",
    "op8_repeated_passages": f"""
        with w as (select doc_id, hash(doc_id, text) as copy, any_value({_WORDS}) as w from documents group by 1, 2),
        g as (select doc_id, copy, i - 1 as place, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, copy, w, unnest(range(1, len(w) - 48)) as i from w)),
        d as (select h from g group by h having count(distinct copy) > 1),
        m as (select doc_id, copy, place, case when place <= lag(place) over (partition by doc_id, copy order by place) + 50 then 0 else 1 end as new from g semi join d using (h)),
        k as (select *, sum(new) over (partition by doc_id, copy order by place) as part from m)
        select doc_id, min(place)::bigint as start_word, (max(place) + 50)::bigint as end_word, (max(place) + 50 - min(place))::bigint as n_words from k group by doc_id, copy, part""",
}
