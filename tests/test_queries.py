"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from palimpsest.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(v, 6))
    return str(v)


def rows_of(df, columns):
    return sorted(tuple(plain(v) for v in row) for row in df[columns].itertuples(index=False))


#: Queries that SQL cannot express; each is held against a plain version below.
PLAIN = {"logistic", "c_grid", "stacked_scores"}


def newton(x, y, weights, c):
    """The intercept and coefficients that minimise weighted log loss and half the coefficients' squares over ``c``."""
    a, w = np.column_stack([np.ones(len(y)), x]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([0.0] + [1 / c] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (weights * p * (1 - p))[:, None]) + ridge, a.T @ (weights * (p - y)) + ridge @ w)
    return w


def predicted(w, x):
    return 1 / (1 + np.exp(-(w[0] + x @ w[1:])))


def balance(y):
    return np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))


def documents():
    docs = pd.read_parquet(f"{SF}/documents.parquet").merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    words = docs.text.str.split(" ")
    docs["size"], docs["noise"] = np.log1p(docs.n_chars), docs.n_chars % 13 / 13
    docs["new"] = words.map(lambda w: len(set(w)) / len(w))
    docs["plain"] = docs.text.map(lambda t: sum(c not in "!*$%&#|" for c in t) / (len(t) + 1))
    return docs


def test_logistic_against_newton(spark):
    docs = documents()
    x, y = docs[["size", "new", "plain"]].to_numpy(), docs.quality.to_numpy(float)
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    want = dict(zip(docs.doc_id, predicted(newton(x, y, balance(y), 1.0), x), strict=True))
    got = {r.doc_id: r.score for r in registry.QUERIES["logistic"](spark, SF).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 2e-3


def area(score, y):
    above = score[y == 1][:, None] - score[y == 0][None]
    return ((above > 0) + 0.5 * (above == 0)).mean()


def test_grid_and_stack_against_newton(spark):
    docs = documents()
    parts = {k: docs[docs.doc_id % 3 == n] for n, k in enumerate(("train", "val", "test"))}
    y = {k: v.quality.to_numpy(float) for k, v in parts.items()}
    raw = {k: v[["size", "noise", "new"]].to_numpy() for k, v in parts.items()}
    x = {k: (v - raw["train"].mean(0)) / raw["train"].std(0, ddof=1) for k, v in raw.items()}
    models = [newton(x["train"], y["train"], balance(y["train"]), c) for c in (0.1, 1.0, 10.0)]
    best = max(models, key=lambda w: area(predicted(w, x["val"]), y["val"]))
    stack = newton(raw["val"][:, [2, 0, 1]], y["val"], np.ones(len(y["val"])), 1.0)
    for name, want in (("c_grid", predicted(best, x["test"])), ("stacked_scores", predicted(stack, raw["test"][:, [2, 0, 1]]))):
        got = {r.doc_id: r.score for r in registry.QUERIES[name](spark, SF).collect()}
        assert sorted(got) == sorted(parts["test"].doc_id)
        assert max(abs(got[i] - s) for i, s in zip(parts["test"].doc_id, want, strict=True)) < 2e-3, name


def test_report(spark):
    lines = []
    registry.report(spark, SF, ["coverage", "storage"], out=lines.append)
    assert [x.split("\n")[1] for x in lines] == ["== coverage", "== storage"] and "documents" in lines[1]
    with pytest.raises(KeyError):
        registry.report(spark, SF, ["none such"])
    registry.report(spark, "/no/such/folder", ["coverage"], out=lines.append)
    assert len(lines) == 2


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    if name not in registry.ORACLE_SQL:
        assert name in PLAIN
        return
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert columns == sorted(want.columns)
    assert rows_of(got.toPandas(), columns) == rows_of(want, columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_outside_the_subpackage_imports_it():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "palimpsest")):
        for n in names:
            if n.endswith(".py") and os.path.basename(folder) != "llm":
                assert "llm" not in open(os.path.join(folder, n)).read(), n
