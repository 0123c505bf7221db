"""A benchmark passage in a long document is a leak, however small its share of the words."""

import random

import pytest

import corpus_pipeline
from tesserix.llm import decontam


@pytest.mark.parametrize("block", [7, decontam.BLOCK_WORDS])
def test_long_documents_with_a_passage_go(spark, docs_of, block):
    r = random.Random(3)
    prose = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    passage = " ".join(f"p{i}" for i in range(30))
    window = " ".join(passage.split()[9:22])
    bench = spark.createDataFrame([(1, passage), (2, "short item"), (3, None)], "item_id long, text string")
    rows = [
        (1, f"{prose(900)} {passage.upper()} {prose(900)}"),
        (2, f"{prose(2000)}, {window}."),
        (3, f"{prose(2000)} {' '.join(window.split()[:12])} {prose(5)}"),
        (4, f"{prose(2000)} short item"),
        (5, f"{prose(30)} short item"),
        (6, None),
    ]
    assert sorted(x["doc_id"] for x in decontam.drop_contaminated(docs_of(rows), bench, block_words=block).collect()) == [3, 4, 6]
    # The query's column keeps the share that its contract fixes.
    found = {x["doc_id"]: (x["n_hit"], x["contaminated"]) for x in decontam.find_contamination(docs_of(rows), bench, block_words=block).collect()}
    assert found == {1: (30, False), 2: (13, False), 3: (0, False), 4: (2, False), 5: (2, True), 6: (0, False)}


def test_the_stage_leaves_no_window_of_the_benchmark(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, docs, sf)
    found = decontam.find_contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    hit = {x["doc_id"] for x in found.filter("n_hit > 0").collect()}
    assert {x["doc_id"] for x in kept.select("doc_id").collect()} == {x["doc_id"] for x in docs.select("doc_id").collect()} - hit
    assert len(hit) == 26
