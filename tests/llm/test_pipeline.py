"""Every stage of the pipeline against a brute-force version of what it does to its own input."""

import hashlib
import struct

import pyarrow as pa
import public_tokenizers
import pytest
from cases import by_force, linked_roots, words_of

import corpus_pipeline
from siltstone.llm import toxicity
from siltstone.llm.common import Stash
from siltstone.llm.mixing import Mix
from siltstone.llm.queries import held_out

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before each stage and behind the last."""
    stash, docs = Stash(spark, "steps"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, SF))
        out.append(docs)
    return out


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"], r.get("text") or ""))


def test_toxic_documents_go(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(toxicity.sample(steps[0], labels, held_out=held_out))
    before = rows(steps[0])
    score = toxicity.scores(pa.array([r["text"] for r in before], pa.string()), model)
    assert rows(steps[1]) == [r for r, s in zip(before, score, strict=True) if s < 0.5]
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    assert toxic - {r["doc_id"] for r in rows(steps[1])}  # of few labels; accuracy is tested on more


def test_one_of_each_group_of_near_copies_stays(steps):
    before = rows(steps[1])
    _, root = linked_roots([r["text"] for r in before], 5, 80)
    assert len(set(root)) < len(before)
    assert rows(steps[2]) == [before[i] for i in sorted(set(root))]


def test_secrets_are_masked(steps):
    hit = 0
    for old, new in zip(rows(steps[2]), sorted(rows(steps[3]), key=lambda r: r["doc_id"]), strict=True):
        out, at = "", 0
        for a, _, b in by_force(old["text"] or "")[1]:
            out, at = (out + old["text"][at:a] + "[SECRET]" if a >= at else out), max(at, b)
        want = None if old["text"] is None else out + old["text"][at:]
        hit += want != old["text"]
        assert new == old | {"text": want, "n_chars": None if old["n_chars"] is None or want is None else len(want)}
    assert hit


def test_the_mix_takes_what_its_plan_says(spark, steps):
    before, after = rows(steps[3]), rows(steps[4])
    mix = Mix(steps[3], Stash(spark, "check"), share=1.5, cap=2.0, floor=1.0)
    taken = {r["doc_id"]: r["taken"] for r in mix.taken().collect()}
    words = {r["doc_id"]: words_of(r["text"]) for r in before}
    got = {}
    for r in after:
        own, w = words[r["doc_id"]], words_of(r["text"])
        step = iter(own)
        assert all(x in step for x in w)  # in order, none that the document lacks
        got.setdefault(r["doc_id"], []).append(len(w))
    assert {d: sum(n) for d, n in got.items()} == {d: n for d, n in taken.items() if n}
    assert all(len(words[d]) in n and sum(n) <= 2 * len(words[d]) for d, n in got.items())
    total = sum(map(len, words.values()))
    assert set(got) == {d for d, w in words.items() if w} and abs(sum(taken.values()) - 1.5 * total) <= 0.05 * total + 64 * len(mix.sources)


def test_tokens_are_the_librarys(steps):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r["doc_id"], r["lang"], r["source"], t.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows(steps[4]))
    got = sorted((r["doc_id"], r["lang"], r["source"], list(r["ids"])) for r in steps[5].collect())
    assert got == want
    for r in steps[5].limit(20).collect():
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(b"".join(struct.pack("<I", i) for i in r["ids"])).hexdigest()
