import collections

import numpy as np
import pytest
import regex

import corpus_pipeline
from strandline.llm import mixing
from tests.llm.fixtures import documents
from tests.llm.test_operators import bag, probability_jaccard


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_and_empty_tables(spark, sf_dir, stage):
    name, f = corpus_pipeline.STAGES[stage]
    docs = documents(spark)
    out = f(spark, docs, sf_dir)
    if name != "packing":
        assert out.columns == docs.columns
    assert out.count() > 0
    assert f(spark, docs.limit(0), sf_dir).count() == 0


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    told = corpus_pipeline.language(spark, docs, sf_dir)
    assert {r["doc_id"] for r in told.collect()} == {i for i, t in rows.items() if regex.search(r"\p{L}", t)}
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i], i)
    unique = corpus_pipeline.exact_dedup(spark, told, sf_dir)
    left = {r["doc_id"] for r in unique.collect()}
    assert left == {i for t, i in first.items() if regex.search(r"\p{L}", t)}
    bags, holders, parent = {i: bag(rows[i]) for i in left}, collections.defaultdict(list), {i: i for i in left}
    for i, b in bags.items():
        for x in b:
            holders[x].append(i)
    together = collections.Counter((min(i, j), max(i, j)) for h in holders.values() for n, i in enumerate(h) for j in h[n + 1 :])

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, j), n in together.items():
        if n > 0.5 * max(len(bags[i]), len(bags[j])) and probability_jaccard(bags[i], bags[j]) >= 0.8:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    near = corpus_pipeline.near_dedup(spark, unique, sf_dir)
    assert {r["doc_id"] for r in near.collect()} == {i for i in left if find(i) == i}
    mixed = corpus_pipeline.mix(spark, near, sf_dir)
    drawn = {r["doc_id"] for r in mixed.collect()}
    assert drawn <= {r["doc_id"] for r in near.collect()} and drawn


def test_run_packs_what_the_stages_keep(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    by_sequence = collections.Counter()
    for r in out:
        by_sequence[r["sequence_id"]] += r["length"]
        assert len(r["ids"]) == 4 * r["length"]
    assert max(by_sequence.values()) <= 4096 and np.mean(list(by_sequence.values())) > 0.9 * 4096
    assert mixing.BROADCAST_CELLS > 0
