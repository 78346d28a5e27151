import re

import corpus_pipeline
from quadrille.llm.spark_io import table, written
from tests.llm.conftest import SF
from tests.llm.test_dedup import WORD, brute_words
from tests.llm.test_leaks import holds
from tests.llm.test_likeness import brute_alike
from tests.llm.test_pieces import library
from tests.llm.test_quality import brute as quality


def test_stages_in_order_with_their_decisions(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    seen = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, SF), f"test{k}")
        last = k == len(corpus_pipeline.STAGES) - 1
        assert last or docs.columns == names
        now = {r.doc_id: None if last else r.text for r in docs.collect()}
        assert now.keys() <= seen.keys()
        if name == "quality rules":
            assert now.keys() == {i for i, t in seen.items() if quality(t)[6]}
        if name == "near duplicates":
            groups = brute_alike(seen)
            assert now.keys() == {i for i, g in groups.items() if i == g}
        if name == "repeated passages":
            gone = {r[0]: r[1:3] for r in brute_words(list(seen.items()))}
            assert now.keys() == {i for i, (n, k) in gone.items() if k < n or not n}
            assert all(len(re.findall(WORD, now[i])) == gone[i][0] - gone[i][1] for i in now)
        if name == "decontamination":
            bench = [r.text for r in table(spark, SF, "benchmark").collect()]
            assert all(i not in now for i, t in seen.items() if any(holds(t, b) for b in bench))
            assert len(now) > 0.9 * len(seen)  # clean documents stay
            assert all(now[i] == seen[i] for i in now)
        if last:
            sp = library()
            assert now.keys() == seen.keys()
            assert all(r.token_ids == sp.encode(seen[r.doc_id]) and r.round_trip for r in docs.collect())
        seen = now
    assert len(seen) > 50
