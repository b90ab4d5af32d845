"""Explicit schemas of the tables that the engine reads and writes."""

CHUNK = "chunk_id string, doc_id string, source string, text string, token_len int, doc_chunk_no int"
RAW_PAIR = "chunk_id string, doc_id string, source string, task string, question string, answer string, quote string, difficulty string, passage string"
VERDICT = "k string, correct int, grounded boolean"
MESSAGES = "array<struct<role:string,content:string>>"
META = "struct<task:string,mode:string,source:string,difficulty:string,chunk_id:string,doc_id:string,golden_present:boolean,answerable:boolean,pair_id:string,cond:string>"
CHAT = f"messages {MESSAGES}, meta {META}"
RAW_PREF = "prompt_id string, question string, passage string, source string, chosen string, rejected string"
PREF_VERDICT = "prompt_id string, chosen_wins boolean, margin int"
PREF = f"prompt {MESSAGES}, chosen string, rejected string, meta struct<source:string,judge_margin:int,prompt_id:string>"
SCORES = "struct<token_f1:double,exact_match:double,fabrication:double,abstain:double,false_abstain:double,reward:double,resp_len_words:double>"
JUDGE = "struct<correct:int,grounded:boolean,matches_ref:boolean,model:string>"
EVAL_ITEM = f"cond string, pair_id string, source string, answerable boolean, system string, user string, ref string, resp string, scores {SCORES}, judge {JUDGE}"
LEDGER = "workspace string, source string, apps array<struct<app:string,usd:double>>"


def as_struct(columns: str) -> str:
    """The columns as fields of a struct: 'a int, b string' as 'a:int,b:string'."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(columns).simpleString().removeprefix("struct<").removesuffix(">")
