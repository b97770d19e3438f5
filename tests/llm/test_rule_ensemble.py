import math
import zlib

import numpy as np
import pytest

from palimpsest.llm import queries
from palimpsest.llm import rule_ensemble as re_
from palimpsest.llm.common import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    scored = queries.op3_rule_ensemble(spark, SF)
    assert scored.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = scored.join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_columns_agree_with_the_model(spark):
    docs = table(spark, SF, "documents")
    model = re_.train(docs, table(spark, SF, "labels"))
    rows = re_.with_statistics(docs).limit(200).select("*", model.score().alias("s")).collect()
    x = np.array([[r[f"__{n}"] for n in re_.NAMES] for r in rows], float)
    assert np.allclose(model.predict(x), [r.s for r in rows], atol=1e-9)
    assert 0 < len(model.rules) < 200 and all("and" in str(r) or ">" in str(r) or "<=" in str(r) for r, _ in model.rules)


def plain_statistics(text):
    text = text or ""
    some, words, lines = max(1, len(text)), text.split(" "), text.split("\n")
    share = [sum(text.count(c) for c in chars) / some for chars in re_._CLASSES.values()]
    return [math.log1p(len(text)), *share, len(text) / len(words), len(set(words)) / len(words), len(set(lines)) / len(lines), math.log1p(len(text) / len(lines))]


def test_query_against_a_plain_version(spark):
    """op3's rows over its whole table: statistics, the sample and each rule written out; the fit itself is shared."""
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    known = sorted(i for i, y in labels.items() if y is not None and i in docs and kept(i))
    model = re_.fit(np.array([plain_statistics(docs[i]) for i in known]), np.array([float(labels[i]) for i in known]))
    rows = queries.op3_rule_ensemble(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        x, total = plain_statistics(docs[r.doc_id]), model.intercept
        for rule, weight in model.rules:
            if all((x[f] > at) if above else (x[f] <= at) for f, above, at in rule.terms):
                total += weight
        score = 1 / (1 + math.exp(-total))
        assert abs(score - r.score) < 1e-9 and r.predicted == int(r.score >= 0.7) and r.held_out == (not kept(r.doc_id))


def test_repeated_ids_clashing_columns_and_very_long_texts(spark):
    rows = [(1, "a word " * 400_000, *"abcd")] + [(7, f"text {k}", *"abcd") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __upper string, __Digit string, ___space string, predicted string")
    labels = spark.createDataFrame([(7, 1), (1, 0)], "doc_id long, quality int")
    model = re_.train(docs, labels, sample=50)
    out = re_.score(docs, model)
    assert out.columns == ["doc_id", "text", "__upper", "__Digit", "___space", "score", "predicted"] and out.count() == 301
    assert {tuple(r) for r in out.select("__upper", "__Digit", "___space").collect()} == {tuple("abc")}


def test_lasso_drops_noise():
    draw = np.random.default_rng(0)
    holds = (draw.random((2000, 30)) < 0.5).astype(float)
    y = (draw.random(2000) < 1 / (1 + np.exp(-(4 * holds[:, 3] - 2)))).astype(float)
    _, w = re_.lasso(holds, y, penalty=0.02)
    assert int(np.abs(w).argmax()) == 3 and (np.abs(w) > 1e-6).sum() < 10


@pytest.mark.parametrize("labels", [[], [(5, 1)], [(5, 1), (6, None), (None, 0), (5, 1)]])
def test_odd_rows(spark, odd, none, labels):
    model = re_.train(odd, spark.createDataFrame(labels, "doc_id long, quality int"))
    out = re_.score(odd, model)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert all(r.score is not None and 0 <= r.score <= 1 and r.predicted in (0, 1) for r in out.collect())
    assert re_.score(none, model).count() == 0
