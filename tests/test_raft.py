"""Retrieval examples against a walk through the whole ring."""

import hashlib

from siltstone.functions.text import ABSTAIN
from siltstone.plans.scoring import eval_four_conditions, raft_mix


def order(seed, i):
    return int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:8], 16)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def shown(docs, question):
    return "\n\n".join(f"[Document {k + 1}]\n{t}" for k, t in enumerate(docs)) + f"\n\nQuestion: {question}"


def table(spark, path):
    """Short documents, one window each: ids divisible by 5 give qa pairs, those before them unanswerable ones; most share a text."""
    text = lambda i: f"{'same words' if i % 4 else f'other words {i}'} in a passage of some length with more to say about it"
    rows = [(i, text(i // 5), "s", "en") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{path}/documents.parquet")
    pairs = [(i * 1_000_000, i, t) for i, t, _, _ in rows]
    return [p for p in pairs if p[1] % 5 == 0], [p for p in pairs if p[1] % 5 == 4]


def distractors(ring, at, own, doc):
    ds = []
    for _, d, t in ring[at + 1 :] + ring[: at + 1]:
        if t != own and d != doc and t not in ds and len(ds) < 2:
            ds.append(t)
    return ds


def question(t):
    return " ".join(t.split()[:8]) + "?"


def answer(i, t):
    w = t.split()
    return " ".join(w[4:12]) + " reason 42 elsewhere" if i % 3 == 0 else " ".join(w[4:20])


def test_three_parts(spark, tmp_path):
    golden, un = table(spark, tmp_path)
    ring = sorted(golden, key=lambda p: (order(11, p[0]), p[0]))
    un = sorted(un, key=lambda p: (order(12, p[0]), p[0]))
    size = len(ring)
    n_golden = int(size * 0.8)
    absent = int(n_golden * 0.1)
    answerable = n_golden - absent
    want = {}

    def add(part, i, turn, t, at, doc, reply, with_golden):
        ds = distractors(ring, at, t, doc)
        if with_golden:
            ds.insert(order(13, i) % (len(ds) + 1), t)
        want[part, i, turn] = (sha(shown(ds, question(t))), sha(reply), len(ds), part != "c", part == "a")

    for at, (i, doc, t) in enumerate(ring[:answerable]):
        quote = " ".join(t.split()[8:14])
        add("a", i, 0, t, at, doc, f"##begin_quote## {quote} ##end_quote##\n{answer(i, t)}", True)
    for at, (i, doc, t) in enumerate(un[:absent]):
        add("b", i, 0, t, at, doc, ABSTAIN, True)
    for turn in range(size - len(want)):
        at = (answerable + turn) % size
        i, doc, t = ring[at]
        add("c", i, turn, t, at, doc, ABSTAIN, False)
    got = {(r.part, r.id, r.i): (r.user_hash, r.answer_hash, r.n_docs, r.golden_present, r.answerable) for r in raft_mix(spark, str(tmp_path)).collect()}
    assert len(want) == size and got == want
    assert {k[0] for k in want} == {"a", "b", "c"} and {v[2] for k, v in want.items() if k[0] == "a"} == {3}


def test_four_conditions(spark, tmp_path):
    golden, _ = table(spark, tmp_path)
    ring = sorted(golden, key=lambda p: (order(11, p[0]), p[0]))
    want = {}
    for at, (i, doc, t) in enumerate(ring):
        ds, q, a = distractors(ring, at, t, doc), question(t), answer(i, t)
        mixed = [x for _, x in sorted((hashlib.md5(f"{i}|{k + 1}".encode()).hexdigest(), x) for k, x in enumerate([*ds, t]))]
        for cond, user, ref in (("clean", shown([t], q), a), ("realistic", shown(mixed, q), a), ("retrieval_failure", shown(ds, q), ABSTAIN), ("closed_book", q, a)):
            want[i, cond] = sha(user), sha(ref)
    assert {(r.id, r.cond): (r.user_hash, r.ref_hash) for r in eval_four_conditions(spark, str(tmp_path)).collect()} == want
