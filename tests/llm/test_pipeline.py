import re

import corpus_pipeline as P
from textloom.llm import queries as Q


def test_stages():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "bpe"]
    assert P.ORACLE_SQL is None


def test_each_stage_on_its_input(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(P.STAGES) - 1:
            assert out.columns == columns
        kept[name] = (docs, out)
        docs = out
    start, mild = kept["toxicity"]
    scores = {r.doc_id: r.predicted for r in Q.op2_toxicity(spark, small).collect()}
    assert {r.doc_id for r in mild.collect()} == {i for i, p in scores.items() if not p}
    before, after = kept["exact dedup"]
    norm = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    first = {}
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r.doc_id)
    assert {r.doc_id for r in after.collect()} == set(first.values())
    before, after = kept["near dedup"]
    from test_near_dedup import brute

    groups = brute([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {min(g) for g in groups}
    before, after = kept["mixing"]
    size = lambda t: len(re.findall("[^ \t-\r]+", t or ""))
    total = lambda df: sum(size(r.text) for r in df.collect())
    assert abs(total(after) - total(before)) < 0.05 * total(before)
    before, after = kept["bpe"]
    assert before.count() == after.count() and after.where("size(ids) <> n_tokens").count() == 0


def test_run(spark, small):
    out = P.run(spark, small)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"] and out.count() > 0


def test_stages_on_odd_rows(spark, small, stored, edge_rows, prose):
    """Null ids, texts and sources, empty and long texts, repeated rows, columns of clashing names; then no rows at all."""
    from conftest import unharmed

    rows = edge_rows + [(100 + i, prose(60, i // 2), "s") for i in range(20)] + [(None, prose(60, 3), "s")]
    for docs in (stored(rows), stored(rows).limit(0)):
        many = docs.count()
        for k, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, small)
            if k < len(P.STAGES) - 1:
                assert out.columns == docs.columns and out.count() <= 3 * max(many, 1)
                assert not many or unharmed(out)
                docs = out.checkpoint()
            else:
                assert out.columns == [c for c in docs.columns if c not in ("text", "n_tokens", "ids")] + ["n_tokens", "ids"]
                assert out.count() == docs.count() and out.where("size(ids) <> n_tokens").count() == 0
        texts = {r.text for r in docs.collect()}
        assert not many or {prose(60, i) for i in range(10)} & texts
