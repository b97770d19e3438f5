import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import change, novelty
from palimpsest.operators import reports as findings

REPORTS = [
    ("a19", 1, date(2019, 12, 31), datetime(2020, 2, 20), 1), ("a20", 1, date(2020, 12, 31), datetime(2021, 2, 20), 1), ("a19x", 1, date(2019, 12, 31), datetime(2021, 3, 15), 2),
    ("a21", 1, date(2021, 12, 31), datetime(2022, 2, 20), 1), ("a23", 1, date(2023, 12, 31), datetime(2024, 2, 20), 1),
]
TEXTS = {"a19": "risk alpha beta gamma", "a20": "risk alpha beta delta", "a19x": "risk totally rewritten words", "a21": "risk alpha beta delta", "a23": "risk new"}


@pytest.fixture(scope="module")
def frames(spark):
    reports = spark.createDataFrame(REPORTS, "accession string, cik long, fiscal_period_end date, accepted_at timestamp, version_no long")
    return reports, spark.createDataFrame([(a, "mdna", "found", t) for a, t in TEXTS.items()], "accession string, section string, status string, text string")


def test_pairs_never_look_ahead(frames):
    assert {(r.accession, r.prior_accession) for r in change.point_in_time_pairs(*frames).collect()} == {("a20", "a19"), ("a21", "a20")}


def test_similarities(frames):
    rows = {r.accession: r for r in change.section_changes(*frames).collect()}
    a21, a20 = rows["a21"], rows["a20"]
    assert all(abs(a21[c] - 1) < 1e-12 for c in ("sim_cosine", "sim_jaccard", "sim_tfidf", "sim_tfidf_pit"))
    assert (a20.words, a20.prior_words) == (4, 4) and a20.sim_cosine == pytest.approx(0.75) and a20.sim_jaccard == pytest.approx(0.6)
    # a20 weighs by a19 alone, known before 2021: its words 1, the unseen delta as much as the rarest seen.
    assert a20.sim_tfidf_pit == pytest.approx(0.75)


def test_a_later_paired_document_changes_no_earlier_weight(spark, frames):
    reports, sections = frames
    more = spark.createDataFrame([("b1", 2, date(2021, 12, 31), datetime(2022, 3, 1), 1), ("b2", 2, date(2022, 12, 31), datetime(2023, 3, 1), 1)], reports.schema)
    texts = spark.createDataFrame([("b1", "mdna", "found", "gamma gamma delta"), ("b2", "mdna", "found", "gamma other words")], sections.schema)
    before = {r.accession: r for r in change.section_changes(reports, sections).collect()}
    after = {r.accession: r for r in change.section_changes(reports.unionByName(more), sections.unionByName(texts)).collect()}
    assert after["a20"].sim_tfidf_pit == before["a20"].sim_tfidf_pit and after["a21"].sim_tfidf_pit == before["a21"].sim_tfidf_pit
    assert after["a20"].sim_tfidf != before["a20"].sim_tfidf and set(after) == {"a20", "a21", "b2"}


def test_no_earlier_year_gives_nan(spark):
    reports = spark.createDataFrame([("x1", 1, date(2019, 12, 31), datetime(2020, 2, 1), 1), ("x2", 1, date(2020, 12, 31), datetime(2020, 12, 31, 23), 1)], "accession string, cik long, fiscal_period_end date, accepted_at timestamp, version_no long")
    sections = spark.createDataFrame([("x1", "mdna", "found", "one two"), ("x2", "mdna", "found", "one 2")], "accession string, section string, status string, text string")
    row = change.section_changes(reports, sections).first()
    assert math.isnan(row.sim_tfidf_pit) and row.sim_jaccard == 0.5
    empty = change.section_changes(reports, sections.withColumn("text", F.lit("1 2")))
    assert math.isnan(empty.first().sim_cosine) and empty.first().words == 0
    assert change.section_changes(reports.limit(0), sections).count() == 0


def test_tokens_and_units(spark):
    row = spark.sql("select 'It''s a well-known Café: x9 O''Brien''s' as t").select(text.tokens(F.col("t")).alias("t")).first().t
    assert row == ["it's", "a", "well-known", "caf", "x", "o'brien's"]
    pair = spark.createDataFrame([(1, "the cat sat", "the cat ran"), (2, "", "x")], "k long, a string, b string")
    got = {r.k: r for r in change.pair_similarity(pair, ["k"], "a", "b").collect()}
    assert got[1].sim_jaccard == pytest.approx(2 / 4) and got[1].sim_cosine == pytest.approx(2 / 3) and math.isnan(got[2].sim_cosine)
    assert pair.select(text.jaccard(text.tokens(F.col("a")), text.tokens(F.col("b"))).alias("j"), "k").where("k = 1").first().j == pytest.approx(0.5)


def test_auc_counts_ties_half(spark):
    rows = spark.createDataFrame([("m", 0.1, True), ("m", 0.5, True), ("m", 0.5, False), ("m", 0.9, False), ("m", None, True), ("m", float("nan"), True)], "k string, s double, y boolean")
    got = findings.area_under_curve(rows, ["k"], "s", "y").first()
    assert (got.positives, got.negatives) == (2, 2) and got.auc == pytest.approx(0.125)


def test_novelty_in_parts(spark, monkeypatch):
    """Parts of either side, copies, vectors that are zero, missing, of single precision or of another length; against all pairs."""
    monkeypatch.setattr(novelty, "PART", 3, raising=False)
    rng = random.Random(3)
    vectors = lambda n, d: [[rng.gauss(0, 1) for _ in range(d)] for _ in range(n)]
    cur = [(k, 100 * k + i, float(rng.randrange(1, 5)), v) for k in (1, 2, 3) for i, v in enumerate(vectors(11, 4) + vectors(2, 3) + [[0.0] * 4, None, [1.0, None, 0.0, 0.0]])]
    prior = [(k, v) for k in (1, 2) for v in vectors(9, 4) + [[1.0, 0.0, 0.0, 0.0]] * 7 + [[0.0] * 4, None]]
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    whole = lambda v: v is not None and len(v) == 4 and None not in v and any(v)
    want = {}
    for k in (1, 2):
        near = [(w, max(cosine(v, p) for q, p in prior if q == k and whole(p))) for c, _, w, v in cur if c == k and whole(v)]
        want[k] = (sum(w * (1 - x) for w, x in near) / sum(w for w, _ in near), len(near))
    for kind in ("double", "float"):
        made = novelty.novelty(spark.createDataFrame(cur, f"k long, id long, weight double, embedding array<{kind}>"), spark.createDataFrame(prior, f"k long, embedding array<{kind}>"), ["k"])
        got = {r.k: (r.novelty, r.paragraphs) for r in made.collect()}
        assert got.keys() == want.keys() and all(got[k] == (pytest.approx(want[k][0], abs=1e-6), 11) and want[k][1] == 11 for k in want)


def test_novelty_and_edits(spark):
    cur = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (1, 2, 3.0, [0.0, 2.0]), (2, 3, 1.0, [1.0, 1.0])], "k long, id long, weight double, embedding array<double>")
    prior = spark.createDataFrame([(1, [1.0, 0.0]), (1, [-1.0, 0.0])], "k long, embedding array<double>")
    assert [tuple(r) for r in novelty.novelty(cur, prior, ["k"]).collect()] == [(1, 0.75, 2)]
    a, b = " ".join("abcdefghij"), " ".join("abcdefghik")
    pairs = spark.createDataFrame([(1, f"{a}\n{'z ' * 10}", f"{b}\n{b}\n{a}x")], "k long, text string, prior_text string")
    got = novelty.edit_pairs(pairs, ["k"], size=10).collect()
    assert [(r.paragraph, r.prior_paragraph) for r in got] == [(a, b)] and got[0].overlap == pytest.approx(9 / 11)
