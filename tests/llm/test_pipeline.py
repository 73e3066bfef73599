import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from framewright.llm.quality import quality, trusted_documents
from tests.llm.test_decontaminate import brute as leaks_of
from tests.llm.test_minhash import brute as near_of

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names[0] == "quality classifier" and len(names) == 5

    verdicts = quality(docs, trusted_documents(spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    want = {r.doc_id for r in verdicts if r.accepted}
    kept = corpus_pipeline.keep_good(spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want

    largest = {}
    for i in sorted(want):
        largest[rows[i]] = i
    want = set(largest.values())
    exact = corpus_pipeline.keep_one_of_copies(spark, kept, SF)
    assert exact.columns == docs.columns and {r.doc_id for r in exact.collect()} == want

    near = near_of([(i, rows[i]) for i in want], 5)
    want = {i for i in want if near[i][1] == i}
    single = corpus_pipeline.keep_one_of_near_copies(spark, exact, SF)
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == want

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want -= {d for d, _ in leaks_of([(i, rows[i]) for i in want], items)}
    clean = corpus_pipeline.keep_unleaked(spark, single, SF)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == want

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == want
    for r in out:
        assert r.ids == t.encode(rows[r.doc_id], add_special_tokens=False).ids


#: Ids that a stage keeps of the rows below; None is the row without an id.
KEPT = {
    "quality classifier": [None, 1, 2, 3, 3, 4], "exact dedup": [2, 3, 3, 4], "near dedup": [None, 1, 2, 3, 3, 4],
    "benchmark decontamination": [None, 1, 2, 3, 3, 4], "bpe encoding": [None, 1, 2, 3, 3, 4],
}
EXTRA = ["id", "sha", "c0", "bucket", "_rejected", "_dropped", "_leaked", "_trusted", "keep_id", "kept", "component_id", "accepted", "n_tokens", "words", "prints"]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_nulls_long_texts_repeats_clashing_columns_and_empty_tables(spark, stage):
    rows = [(None, None, None, None, None), (1, None, None, "s", 0), (2, "", "en", None, None), (3, "same", "en", "s", 4), (3, "same", "en", "s", 4), (4, "a longer text " * 60_000, "en", "s", 9)]
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"`{c}` string" for c in EXTRA]]))
    out = stage[1](spark, docs, SF)
    got = out.collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted(KEPT[stage[0]], key=str)
    if stage[0] != "bpe encoding":
        assert out.columns == docs.columns and all(r[c] == c for r in got for c in EXTRA)
    assert stage[1](spark, docs.limit(0), SF).count() == 0
