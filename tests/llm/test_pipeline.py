import corpus_pipeline as P
from glenfare.llm import exact_dedup, language_id, packing, quality_rules, simhash
from helpers import SF, as_rows, documents, edge_docs, empty_docs


def test_stages_and_run(spark):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "language_id", "exact_dedup", "simhash_near_dedup", "packing"]
    docs = documents(spark)
    keep = {r["doc_id"] for r in quality_rules.op3_quality_rules(spark, SF).filter("kept").collect()}
    d1 = docs.filter(docs.doc_id.isin(*keep)).cache()
    keep = {r["doc_id"] for r in language_id.predict(d1, language_id.fit(d1)).filter("accepted").collect()}
    d2 = d1.filter(d1.doc_id.isin(*keep)).cache()
    keep = {r["doc_id"] for r in exact_dedup.exact_groups(d2).filter("kept").collect()}
    d3 = d2.filter(d2.doc_id.isin(*keep)).cache()
    keep = {r["doc_id"] for r in simhash.near_components(d3).filter("doc_id = component_id").collect()}
    d4 = d3.filter(d3.doc_id.isin(*keep))
    pieces = P.run(spark, SF)
    got = {(r["doc_id"], r["doc_tokens"]) for r in pieces.collect()}
    exp = {(r["doc_id"], r["doc_tokens"]) for r in packing.pack(d4, packing.default_tokenizer()).collect()}
    assert got == exp and {i for i, _ in got} == keep


def test_stages_on_edges_and_empty_tables(spark):
    for docs in (edge_docs(spark), empty_docs(spark)):
        n = docs.count()
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= n, name
        assert P.STAGES[-1][1](spark, docs, SF).count() >= n
