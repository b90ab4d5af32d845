"""Nulls, empty tables, repeated rows, clashing names and long texts, for each operator and pipeline stage."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from cases import by_force, some_text, words_of
from pyspark.sql import functions as F

from siltstone.llm import bpe, jaccard, mixing, packing, secret_links, suffixes, tiff, toxicity, warc
from siltstone.llm.common import Stash, new_folder
from siltstone.llm.mixing import Mix, cyclic_weights

CLASHES = ("_n", "_set", "_size", "_hash", "_id", "r_id", "id", "hash", "spans", "base", "weak", "size", "off", "block", "pass", "bucket", "source_no", "shard", "region", "sid", "root", "key", "score", "_toxicity", "_scored_text", "text0", "Text0", "set", "n", "copy", "ranges", "row", "h")
LONG = "long words of a very long text password: abcdefghijkl0123 " * 30_000


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, copies, rows repeated, and columns of clashing names."""
    rng = random.Random(5)
    plain = [some_text(rng, 60) for _ in range(6)]
    rows = [(i, t, "en", "a" if i % 3 else "b", len(t)) for i, t in enumerate(plain)]
    rows += [(0, plain[0], "en", "b", len(plain[0]))] * 2 + [(0, plain[0], "de", "b", None)] + [(10, plain[1], None, None, None), (11, None, "en", "a", 0), (12, "", "en", None, 0), (None, plain[2], "en", "a", 5), (None, None, None, None, None), (13, " \t\n", "en", "a", 3), (14, LONG, "en", "c", len(LONG))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in {c.lower(): c for c in CLASHES}.values():
        d = d.withColumn(c, F.lit(f"kept {c}"))
    return d


def stages():
    import corpus_pipeline

    return corpus_pipeline.STAGES


@pytest.mark.parametrize("number", range(5))
def test_stages_take_odd_and_empty_tables(spark, odd, tmp_path, number):
    spark.createDataFrame([(0, 1, 1), (1, 1, 0), (2, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = stages()[number]
    got = stage(spark, odd, str(tmp_path))
    rows = got.collect()
    if number < 4:
        assert got.columns == odd.columns and all(r["score"] == "kept score" and r["_n"] == "kept _n" for r in rows)
        assert dict(got.dtypes) == dict(odd.dtypes)
    assert rows
    none = stage(spark, odd.limit(0), str(tmp_path))
    assert none.count() == 0 and none.columns == got.columns


def test_mix_as_documents_holds_what_taken_says(spark, odd):
    """Rows repeated, also with other columns that differ: each row's words are taken as often as taken() says."""
    mix = Mix(odd, Stash(spark, "edges"), share=1.5, cap=2.0, floor=1.0)
    words = lambda rows: sorted((str(r["doc_id"]), str(r["source"]), len(words_of(r["text"]))) for r in rows)
    mixed = mix.documents(odd).collect()
    sizes = {}
    for d, s, n in words(mixed):
        sizes[d, s] = sizes.get((d, s), 0) + n
    want = {}
    for p in mix.pieces.select("doc_id", "source", (F.col("end_word") - F.col("first_word")).alias("n")).collect():
        key = str(p["doc_id"]), str(p["source"])
        want[key] = want.get(key, 0) + p["n"]
    assert sizes == want
    by_doc = {}
    for r in mix.taken().collect():
        by_doc[str(r["doc_id"])] = by_doc.get(str(r["doc_id"]), 0) + r["taken"]
    for key in want:
        assert sum(n for (d, _), n in want.items() if d == key[0]) == by_doc[key[0]]
    # With a floor of 1 every row is there whole at least once.
    assert sorted(r["lang"] for r in mixed if r["doc_id"] == 0 and r["lang"] == "de") and sum(r["doc_id"] == 0 for r in mixed) >= 4


def test_two_equal_rows_do_not_multiply(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h", "en", "s"), (1, "a b c d e f g h", "de", "s")], "doc_id long, text string, lang string, source string")
    mixed = Mix(d, Stash(spark, "edges"), share=1.5, cap=2.0).documents(d).collect()
    assert sum(len(words_of(r["text"])) for r in mixed) == 24


@pytest.mark.parametrize("good,bad,n", [(5, 7, 4), (40, 60, 30), (1000, 3, 500), (5000, 9000, 7000), (10**10, 3 * 10**10, 4000), (3, 10**12, 10**11)])
def test_draws_without_replacement_follow_their_law(good, bad, n):
    """Mean and variance, below and beyond the sizes that NumPy's generator takes."""
    rng = np.random.Generator(np.random.Philox(key=[1, 2]))
    x = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(4000)], float)
    total = good + bad
    mean, variance = n * good / total, n * good / total * bad / total * (total - n) / (total - 1)
    assert x.min() >= max(0, n - bad) and x.max() <= min(good, n)
    assert abs(x.mean() - mean) < 5 * (variance / len(x)) ** 0.5 + 1e-9
    assert variance < 0.01 or abs(x.var() / variance - 1) < 0.15


def test_mix_equals_a_plain_walk_through_the_slots(spark, docs):
    """Every slot's words, laid out on the driver from the plan, are what taken() counts."""
    rng = random.Random(8)
    texts = [some_text(rng, rng.randrange(0, 300)) for _ in range(120)] + [None]
    mix = Mix(docs(texts, [["x", "y", None][i % 4 % 3] for i in range(121)]), Stash(spark, "edges"), weights=cyclic_weights, share=1.5, cap=2.0, block=16, shard=64)
    owner = [np.full(s.size, -1) for s in mix.sources]
    for r in mix.rows.collect():
        owner[r["source_no"]][r["off"] : r["off"] + r["size"]] = r["doc_id"]
    assert all((o >= 0).all() for o in owner)
    taken = np.zeros(121, int)
    slots = 0
    for shard in range(mix.plan.shards):
        p = mix.plan.slots_of(shard)
        slots += len(p)
        assert len(p) == 64 or shard == mix.plan.shards - 1
        for s, b, w in zip(p["source_no"], p["block"], p["words"], strict=True):
            np.add.at(taken, owner[s][b * 16 : b * 16 + w], 1)
    assert slots == mix.plan.slots.sum()
    assert {r["doc_id"]: r["taken"] for r in mix.taken().collect()} == dict(enumerate(taken.tolist()))


def secret_text(rng):
    pick = lambda n, of="abcdefABCDEF0123456789xyzXYZ": "".join(rng.choice(of) for _ in range(n))
    kinds = (lambda: f"user_id: {pick(6)}", lambda: pick(30), lambda: f"https://h{pick(3)}.example.com/{pick(5)}", lambda: "AKIA" + pick(16, "ABCDEFGH0123"), lambda: f"token = '{pick(14)}'", lambda: pick(20, "0123456789abcdef"), lambda: f"secret={pick(5)}", lambda: "é😀" * 3)
    return " ".join(rng.choice(kinds)() if rng.random() < 0.25 else "word" * rng.randrange(1, 8) for _ in range(rng.randrange(0, 260)))


def test_linked_secrets_equal_brute_force(spark, docs):
    rng = random.Random(4)
    texts = [secret_text(rng) for _ in range(60)] + [None, "", "x " * 200_000 + "user_id: abcd1 secret: abcdefghijklmnop"]
    said = lambda spans: ",".join(f"{secret_links.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    linked = 0
    for r in secret_links.report(docs(texts)).collect():
        base, spans = by_force(texts[r["doc_id"]] or "")
        linked += len(spans) - len(base)
        assert r["spans"] == said(spans), r["doc_id"]
    assert linked > 20


def test_redacted_texts_equal_brute_force(spark, docs):
    rng = random.Random(6)
    texts = [secret_text(rng) for _ in range(40)] + [None, "", "secret=" * 3 + "a" * 20, "ab" * 20 + " " + "cd" * 20]
    for r in secret_links.redact(docs(texts)).collect():
        text, at, out = texts[r["doc_id"]], 0, ""
        for a, _, b in by_force(text or "")[1]:
            out, at = (out + text[at:a] + "[SECRET]" if a >= at else out), max(at, b)
        assert r["text"] == (None if text is None else out + text[at:])


def test_many_matches_in_one_text_take_linear_time(spark, docs):
    one = "password: abcdefghijklmnop0 "

    def seconds(n):
        d = docs([one * n])
        begin = time.perf_counter()
        got = secret_links.redact(d).collect()[0]["text"]
        assert got.count("[SECRET]") == n
        return time.perf_counter() - begin

    seconds(100)
    assert seconds(32_000) < 12 * max(1.0, seconds(4_000))


def test_packing_reads_back(spark, docs):
    """Every document's ids come together again from the matrix; offsets, lengths and resets say where."""
    rng = random.Random(3)
    texts = [some_text(rng, rng.randrange(0, 90)) for _ in range(70)] + [None, "", some_text(rng, 3000), "same text here", "same text here"]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encode = packing.byte_pair_encoder(path, public_tokenizers.PATTERN)
    cut = packing.pieces(docs(texts), 64, packing.byte_pair_encoder, (path, public_tokenizers.PATTERN), 50_256, kind="<u2")
    rows = packing.pack(cut, 64, 50_256, "<u2").collect()
    got = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2")
        cu = r["cu_seqlens"]
        assert len(ids) == 64 and cu[0] == 0 and cu[-1] == r["n_tokens"] <= 64 and list(np.diff(cu)) == r["lengths"] and r["position_resets"] == cu[:-1]
        assert (ids[r["n_tokens"] :] == 50_256).all()
        for d, at, lo, hi in zip(r["doc_ids"], r["offsets"], cu, cu[1:], strict=False):
            assert (d, at) not in got
            got[d, at] = ids[lo:hi]
    for d, t in enumerate(texts):
        want = encode([t or ""])[0]
        own = [got.pop(k) for k in sorted(k for k in got if k[0] == d)]
        assert (np.concatenate(own).tolist() if own else []) == ([*want.tolist(), 50_256] if len(want) else [])
    assert not got
    full = sum(r["n_tokens"] for r in rows)
    assert len(rows) <= 1.1 * full / 64 + 4
    assert packing.pack(packing.pieces(docs([]), 64, packing.byte_pair_encoder, (path, public_tokenizers.PATTERN)), 64).count() == 0


def test_best_fit_equals_a_search_through_all_rows():
    rng = random.Random(2)
    for _ in range(30):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(0, 60))]
        room, want = [], []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [r for r in range(len(room)) if room[r] >= sizes[i]]
            if fits:
                least = min(room[r] for r in fits)
                r = fits[0]
                for x in fits:
                    if room[x] == least:
                        r = x
            else:
                r = len(room)
                room.append(40)
                want.append([])
            room[r] -= sizes[i]
            want[r].append(sizes[i])
        got = [[sizes[i] for i in r] for r in packing.best_fit(sizes, 40)]
        assert sorted(map(sum, got)) == sorted(map(sum, want)) and len(got) == len(want)


def test_operators_take_odd_tables(spark, odd):
    n = odd.count()
    assert jaccard.joined(odd, 4, 85).count() == n
    assert secret_links.report(odd).count() == n
    assert tiff.text_features(odd).count() == n
    path = public_tokenizers.path("word_bpe_49k.json")
    assert bpe.encode_column(odd, path, with_ids=False).count() == n
    assert toxicity.score_column(odd, toxicity.fit([]), ("doc_id",)).count() == n
    assert {r["doc_id"] for r in suffixes.repeated_passages(odd, shared=50).collect()} >= {1, 10, 2, None}
    assert Mix(odd, Stash(spark, "edges")).taken().count() == n


def test_operators_take_empty_tables(spark, odd):
    none = odd.limit(0)
    assert Mix(none, Stash(spark, "edges")).taken().count() == 0
    assert secret_links.report(none).count() == 0
    assert bpe.encode_column(none, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).count() == 0
    assert toxicity.keep_clean(none, toxicity.fit([])).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = new_folder(spark, "warc-none")
    warc.write(pages, folder, least=0)
    assert warc.read(spark, folder, payloads=False).count() == 0


def test_pages_repeated_with_null_ids(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, "<p>a</p>"), (2, None, None), (3, "u" * 5000, "x" * 500_000)]
    folder = new_folder(spark, "warc-odd")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, least=0)
    got = warc.read(spark, folder, payloads=False).collect()
    assert len(got) == 5 and sum(r["record_type"] == "response" for r in got) == 3 and all(r["error"] is None for r in got)
