"""The deficit interleave over every source."""

from siltstone.plans.curation import deficit_interleave


def test_every_document_is_scheduled(spark, tmp_path):
    counts = {"src0": 40, "src1": 5, "src2": 30, "src3": 40, "other": 38, None: 37}
    rows, n = [], 0
    for source, many in counts.items():
        rows += [(n + i, "t", source, "en") for i in range(many)]
        n += many
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(deficit_interleave(spark, str(tmp_path)).collect(), key=lambda r: r.pos)
    assert [r.pos for r in got] == list(range(n))
    assert {(r.doc_id, r.source) for r in got} == {(i, s) for i, _, s, _ in rows}
    for source in counts:
        ids = [r.doc_id for r in got if r.source == source]
        assert ids == sorted(ids)
    # Until one ends, each source has its share of the turns, give or take one or two.
    weights = {s: {"src0": 0.347, "src1": 0.342, "src2": 0.311}.get(s, 1 / 3) / 2 for s in counts}
    for turns in range(1, 25):
        for source, w in weights.items():
            assert abs(sum(r.source == source for r in got[:turns]) - w * turns) < 2


def test_no_documents_no_schedule(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert deficit_interleave(spark, str(tmp_path)).count() == 0
