import corpus_pipeline
from curatrix.llm import minhash, packing, quality, rules
from curatrix.llm.common import stage, table


def test_stages_take_effect(spark, sf):
    """Each stage keeps the rows that its operator keeps, whole; every input is a written table."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    columns, before = docs.columns, docs.count()
    operators = [lambda d: quality.classify(d, labels), lambda d: rules.quality_rules(d, labels), lambda d: minhash.near_documents(d)]
    for (name, step), operator in zip(corpus_pipeline.STAGES, operators):
        kept = stage(step(spark, docs, sf), name)
        assert kept.columns == columns and ids(kept) == ids(operator(docs).filter("kept")), name
        assert 0 < (left := kept.count()) < before, name
        docs, before = kept, left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.columns == packing.pack(docs).columns
    assert sorted(r["doc_id"] for r in packed.select("doc_id").distinct().collect()) == ids(docs)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and len({(r["doc_id"], r["piece"]) for r in out}) == len(out)


def test_run_equals_queries(spark):
    import __spark_entry__ as entry

    known = entry.queries()
    assert "pipeline" in known and sum(n.startswith("op") for n in known) == 10
