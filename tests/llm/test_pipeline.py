import hashlib

import corpus_pipeline
from palimpsest.llm import queries, rule_ensemble
from palimpsest.llm.common import table

from .test_decontaminate import brute as hits
from .test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_run_against_a_plain_version(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = rule_ensemble.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in rule_ensemble.score(docs, model).where("predicted = 1").collect()]
    best = {}
    for i, t in rows:
        best[t] = max(i, best.get(t, i))
    rows = [(i, t) for t, i in best.items()]
    roots = plain_components({i: plain_fingerprint(t) for i, t in rows}, 4)
    rows = [(i, t) for i, t in rows if roots[i] == i]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    rows = [(i, t) for i, t in rows if not hits(t, items, 8)[2]]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.decoded_sha256) for r in got} == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows} and len(got) == len(rows)


def test_stages_keep_columns_and_survive_odd_rows(spark, odd, none):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_benchmark_passages_go_and_clean_documents_stay(spark):
    items = [r.text for r in table(spark, SF, "benchmark").limit(5).collect()]
    rows = [(i, f"Some words before. {t.upper()} And some after.") for i, t in enumerate(items)]  # a whole item each
    rows += [(10, "before " + " ".join(items[0].split()[3:12]) + " after"), (11, "a clean document"), (12, None), (13, " ".join(items[0].split()[:4]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.benchmark(spark, docs, SF).collect()} == {11, 12, 13}


def test_queries_have_one_of_each():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
