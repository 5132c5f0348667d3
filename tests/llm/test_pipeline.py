"""The pipeline: what each stage lets through, whole and on tables with odd rows."""

import collections

import pytest
from fixtures import FOLDER, edge_docs, edge_texts, empty_docs
from test_near_duplicates import plain_fingerprint, plain_groups, plain_lines, words_of
from test_text_models import plain_leaks

import corpus_pipeline
from clauselake.llm import packing, tokens, toxicity
from clauselake.llm.common import fresh_path, staged


def test_stage_order():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "simhash near-dedup", "benchmark decontamination", "packing"]


def test_stages_against_brute_force(spark):
    """Every stage's rows follow from the rows it was given."""
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, docs, FOLDER), "test-stage")
        assert out.schema == docs.schema
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            scores = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
            want = {d: t for d, t in before.items() if scores[d] < toxicity.THRESHOLD}
        elif name == "line dedup":
            stay = plain_lines([(d, 0, t) for d, t in before.items()])
            want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, 0, i) in stay or not words_of(x)) for d, t in before.items()}
            assert all(r.n_chars == len(r.text) for r in out.collect() if r.text != before[r.doc_id])
        elif name == "simhash near-dedup":
            ids = sorted(before)
            roots = plain_groups([plain_fingerprint(before[d]) for d in ids])
            want = {d: before[d] for k, d in enumerate(ids) if roots[k] == k}
        else:
            bad = {d for d, _ in plain_leaks(before.items(), bench)}
            want = {d: t for d, t in before.items() if d not in bad}
        assert after == want
        docs, before = out, after
    encoder = tokens.Encoder(tokens.default_vocabulary())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    lengths = collections.Counter()
    for p in pieces:
        lengths[p.doc_id] += p.length
    assert lengths == {d: len(encoder.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in before.items()}
    run = corpus_pipeline.run(spark, FOLDER).collect()
    assert collections.Counter(map(tuple, run)) == collections.Counter(map(tuple, pieces))


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_take_odd_and_empty_tables(spark, rows):
    folder = fresh_path(spark, "test-tables")
    spark.createDataFrame([(0, 1, 0), (1, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, edge_texts()[2][1]), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = edge_docs(spark) if rows == "odd" else empty_docs(spark)
    docs.write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, docs, folder), "test-stage")
        assert out.columns == docs.columns
        docs = out
    ids = {r.doc_id for r in docs.collect()}
    pieces = packing.pack(docs).collect()
    assert {p.doc_id for p in pieces} == ids and (2 not in ids)
    assert (rows == "none") == (not ids)
