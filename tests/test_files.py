"""Files that are torn, blank or spread over lines; sinks; prompts and embedders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from siltstone.operators import prompts, sampling
from siltstone.sources import files, providers
from siltstone.streaming import logs


def test_torn_lines_are_left_out_or_stop_a_strict_reader(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\n   \n{"a": 2, "b": "y"\n{"a": 3, "b": null}\nnot json\n{"a": 4}\n')
    schema = "a int, b string"
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path), schema).collect()) == [1, 3, 4]
    assert files.torn_lines(spark, str(tmp_path), schema).count() == 2
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path), schema, strict=True).collect()
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "é😀"}\n\n')
    assert [tuple(r) for r in files.json_lines(spark, str(tmp_path), schema, strict=True).collect()] == [(1, "é😀")]


def test_line_numbers_over_splits(spark, tmp_path):
    lines = [f"line {i} {'x' * (i % 50)}" if i % 7 else "" for i in range(5000)]
    (tmp_path / "shard-000.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "shard-001.txt").write_text("only\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {(os.path.basename(r.file), r.line_no): r.text for r in files.shard_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("shard-000.txt", i): t for i, t in enumerate(lines) if t} | {("shard-001.txt", 0): "only"}


def test_blobs_over_several_lines(spark, tmp_path):
    item = lambda f1, judge=None: {"cond": "clean", "pair_id": "p", "scores": {"token_f1": f1}, "judge": judge}
    for name, f1, judge in (("a.json", 0.1, None), ("a.judged.json", 0.2, {"correct": 4, "grounded": True}), ("b.json", 0.3, None)):
        (tmp_path / name).write_text(json.dumps({"result": {}, "per_item": [item(f1, judge)]}, indent=2))
    got = {(r.version, r.judged, r.scores.token_f1) for r in files.eval_blobs(spark, str(tmp_path), whole=True).collect()}
    assert got == {("a", True, 0.2), ("b", False, 0.3)}
    assert [r.judge.correct for r in files.judged_items(spark, str(tmp_path), whole=True).collect()] == [4]


def test_csv_keeps_order_quotes_and_line_breaks(spark, tmp_path):
    rows = [(1, 'a "b", c', "x"), (2, "two\nlines", None), (3, None, "  ")]
    files.to_csv(spark.createDataFrame(rows, "n int, t string, u string"), f"{tmp_path}/out", ["u", "t", "n"])
    got = files.csv_rows(spark, f"{tmp_path}/out", "u string, t string, n int").collect()
    assert got[0].__fields__ == ["u", "t", "n"] and {r.n: r.t for r in got} == {1: 'a "b", c', 2: "two\nlines", 3: None}
    assert [r.n for r in files.csv_rows(spark, f"{tmp_path}/out", "u string, t string, n int", filled=("u",)).collect()] == [1]


def test_markdown_of_a_report(spark):
    text = files.markdown(spark.createDataFrame([("a|b", 0.5, None)], "k string, v double, w string"), "Scores")
    assert text.splitlines()[0] == "### Scores" and "| a\\|b | 0.500 | n/a |" in text
    with pytest.raises(ValueError):
        files.markdown(spark.range(5), "Long", most=4)


def test_a_stopped_stream_goes_on_behind_what_it_wrote(spark, tmp_path):
    schema = "k int, v string"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"k": 1, "v": "a"}\n{"k": 2, "v"\n')
    run = lambda: logs.append_json(logs.json_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    run()
    (tmp_path / "in/b.jsonl").write_text('{"k": 3, "v": "c"}\n')
    run()
    run()
    assert sorted(r.k for r in files.json_lines(spark, f"{tmp_path}/out", schema).collect()) == [1, 3]


def test_replies_are_asked_for_once(spark):
    asked = []

    def provider(prompts_):
        asked.extend(r.key for r in prompts_.collect())
        return prompts_.select("key", F.concat(F.lit("new "), "prompt").alias("reply"))

    todo = spark.createDataFrame([("a", "p1"), ("b", "p2")], "key string, prompt string")
    log = spark.createDataFrame([("a", "old", 1), ("a", "older", 0)], "key string, reply string, seq long")
    got = {r.key: r.reply for r in providers.ask(todo, provider, log).collect()}
    assert set(asked) == {"b"} and got == {"a": "old", "b": "new p2"}


def test_replies_become_records(spark):
    chunks = spark.createDataFrame([("1", "c", "d", "s", "qa", "text"), ("2", "c", "d", "s", "unanswerable", "text"), ("3", "c", "d", "s", "summarize", "text"), ("4", "c", "d", "s", "qa", "text")], "key string, chunk_id string, doc_id string, source string, task string, text string")
    replies = spark.createDataFrame([("1", '[{"question": "q1", "answer": "a1", "quote": "z"}, {"question": "q2", "answer": "a2", "difficulty": "hard"}]'), ("2", '[{"question": "q3"}]'), ("3", '{"instruction": "i", "answer": "a"}'), ("4", "no JSON")], "key string, reply string")
    got = sorted((r.task, r.question, r.answer, r.quote, r.difficulty) for r in providers.records(chunks, replies, "none").where("question <> ''").collect())
    assert got == [("qa", "q1", "a1", "z", "medium"), ("qa", "q2", "a2", "", "hard"), ("summarize", "i", "a", "", "medium"), ("unanswerable", "q3", "none", "", "medium")]


def test_hashed_embedding_has_unit_length(spark):
    d = spark.createDataFrame([("one two three one two",), ("",), ("ONE  two three one two",)], "t string").select(providers.hashed_embedder(16)(F.col("t")).alias("v")).collect()
    assert abs(sum(x * x for x in d[0].v) - 1) < 1e-9 and d[0].v == d[2].v and not any(d[1].v)


def test_examples_that_fit(spark):
    from siltstone.functions.text import tokens

    rows = [(i, "u " * 5, "a " * 5 if i != 1 else None) for i in range(6)]
    d = spark.createDataFrame(rows, "n int, user string, assistant string")
    assert sorted(r.n for r in providers.shots(d, tokens, "n", 3, 25).collect()) == [0, 2]


def test_prompts_are_filled(spark):
    got = spark.range(1).select(prompts.prompt("judge", passage=F.lit("P"), question=F.lit("Q"), answer=F.lit(None).cast("string")).alias("p")).first().p
    assert got.endswith("PASSAGE:\nP\n\nQUESTION: Q\nANSWER: ")


def test_ranks_within_groups_of_any_ids(spark):
    ids = [(i * i * 7919 - 10**6, "abc"[i % 3] if i % 5 else None) for i in range(400)]
    got = {r.id: r["rank"] for r in sampling.ranks(spark.createDataFrame(ids, "id long, g string"), "g", "id", rows=16).collect()}
    want = {}
    for g in {g for _, g in ids}:
        want |= {i: n + 1 for n, i in enumerate(sorted(i for i, h in ids if h == g))}
    assert got == want
    assert sampling.ranks(spark.createDataFrame([], "id long, g string"), "g", "id").count() == 0
