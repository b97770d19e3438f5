"""Around the models: windows, samples, batches, outputs, and how the viewer writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..functions import formats, text
from ..operators import evaluation, labels, learn, scores
from ..sources import raw
from . import models
from . import standins as s

QUERIES, ORACLE_SQL, register = s.registrar()

_TOKENS = "t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z''-]*[a-z]|[a-z]') AS t FROM documents)"
_WINDOWS = _TOKENS + """,
  w AS (SELECT doc_id, k, t[k * 510 + 1 : k * 510 + 510] AS w FROM t, unnest(range(0, greatest(CAST(ceil(len(t) / 510.0) AS BIGINT), 1))) AS u(k))"""


def _windows(spark: SparkSession, sf: str, most: int | None = scores.WINDOWS) -> DataFrame:
    docs = s.read(spark, sf, "documents").select("doc_id", F.explode(F.array(text.tokens(F.col("text")))).alias("t"))
    return docs.select("doc_id", F.posexplode(scores.windows(F.col("t"), most=most)).alias("k", "w"))


def _vowels(words):
    return F.size(F.filter(words, lambda w: w.rlike("^[aeiou]"))) / F.greatest(F.size(words), F.lit(1))


@register(f"""WITH {_WINDOWS}
  SELECT doc_id, count(*) AS windows, round(avg(len(list_filter(w, lambda x: regexp_matches(x, '^[aeiou]'))) / greatest(len(w), 1)), 6) AS score
  FROM w WHERE k < 64 GROUP BY 1""")
def chunk_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in for the model scores each window: its share of words that begin with a vowel."""
    scored = _windows(spark, sf).withColumn("score", _vowels(F.col("w")))
    return scores.mean_scores(scored, "doc_id").withColumn("score", F.round("score", 6))


@register(f"""WITH {_WINDOWS}
  SELECT doc_id, CAST(k AS INTEGER) AS k, CAST(len(w) AS INTEGER) AS n FROM w
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5('7:' || doc_id || ':' || k), k) <= 8""")
def train_windows(spark: SparkSession, sf: str) -> DataFrame:
    return scores.sample_by(_windows(spark, sf, None), "doc_id", 8, "k").select("doc_id", "k", F.size("w").alias("n"))


@register("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY md5('7:' || l_orderkey || ':' || l_linenumber), l_orderkey, l_linenumber LIMIT 40000")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sample is the point: as many pairs as the model is tuned on."""
    return scores.sample(s.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), 40_000, "l_orderkey", "l_linenumber").drop("place")


@register("""WITH b AS (SELECT conv_id, turn, length(text) AS n, (row_number() OVER (ORDER BY length(text), conv_id, turn) - 1) // 32 AS batch FROM conversations)
  SELECT conv_id, turn, n, batch, max(n) OVER (PARTITION BY batch) AS width FROM b""")
def length_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = s.read(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return scores.length_batches(rows, "n", 32, "conv_id", "turn").select("conv_id", "turn", "n", "batch", "width")


_OUTPUTS = f"""{models._PROSE}, tails AS (SELECT *, text AS answer FROM prose),
  risk AS (SELECT o_orderkey AS accession, o_orderkey % 7 = 0 AS label, round(o_totalprice / 100) AS score FROM orders WHERE o_orderkey % 3 <> 0),
  pct AS (SELECT accession, label AS event_next_12m, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) / count(*) OVER () AS risk_pct FROM risk),
  said AS (SELECT o_orderkey AS accession, o_orderkey % 4 <> 0 AS answerable, {models._ANSWER} AS usd FROM {models._TAIL} WHERE o_orderkey % 5 <> 0)"""


def _outputs(spark: SparkSession, sf: str) -> DataFrame:
    risk = s.read(spark, sf, "orders").where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS accession", "o_orderkey % 7 = 0 AS label", "round(o_totalprice / 100) AS score")
    said = models._prose(spark, sf).where("o_orderkey % 5 <> 0").selectExpr("o_orderkey AS accession", "o_orderkey % 4 <> 0 AS answerable", "text AS qlora", "CASE WHEN o_orderkey % 2 = 0 THEN text ELSE 'unknown' END AS zero_shot")
    return scores.model_outputs(risk, said)


@register(f"""WITH {_OUTPUTS}
  SELECT accession, CAST(event_next_12m AS VARCHAR) AS event_next_12m, round(risk_pct, 6) AS risk_pct, CAST(answerable AS VARCHAR) AS answerable, round(usd, 2) AS qlora_usd, CASE WHEN accession % 2 = 0 THEN round(usd, 2) END AS zero_shot_usd FROM pct FULL JOIN said USING (accession)""")
def model_outputs(spark: SparkSession, sf: str) -> DataFrame:
    out = _outputs(spark, sf)
    return out.withColumns({c: F.col(c).cast("string") for c in ("event_next_12m", "answerable")} | {"risk_pct": F.round("risk_pct", 6), "qlora_usd": F.round("qlora_usd", 2), "zero_shot_usd": F.round("zero_shot_usd", 2)})


@register(s.with_("filings", "headers", "stored", "reports", more=_OUTPUTS) + """
  SELECT a.accession, a.cik, a.version_no, CAST(p.event_next_12m AS VARCHAR) AS event_next_12m, round(p.risk_pct, 6) AS risk_pct,
    CAST(d.answerable AS VARCHAR) AS answerable FROM annual_reports a LEFT JOIN pct p USING (accession) LEFT JOIN said d USING (accession)
    WHERE a.stored_path IS NOT NULL""")
def export_outputs(spark: SparkSession, sf: str) -> DataFrame:
    reports = s.reports(spark, sf).where("stored_path is not null").select("accession", "cik", "version_no")
    out = scores.with_outputs(reports, _outputs(spark, sf))
    return out.select("accession", "cik", "version_no", F.col("event_next_12m").cast("string").alias("event_next_12m"), F.round("risk_pct", 6).alias("risk_pct"), F.col("answerable").cast("string").alias("answerable"))


_EVENTS = ("view", "click", "error")


@register("""WITH m AS (SELECT event_id, event_type, value AS a, (user_id % 50) / 50.0 AS b FROM events WHERE value IS NOT NULL),
  l AS (SELECT 'a' AS model, event_type, a AS score FROM m UNION ALL SELECT 'b', event_type, b FROM m),
  x AS (SELECT model, e AS event, (event_type = e)::int AS label, score FROM l, unnest(['view', 'click', 'error']) AS t(e)),
  r AS (SELECT *, rank() OVER (PARTITION BY model, event ORDER BY score) + (count(*) OVER (PARTITION BY model, event, score) - 1) / 2.0 AS r FROM x)
  SELECT model, event, round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 3) AS auc FROM r GROUP BY ALL""")
def auc_by_event(spark: SparkSession, sf: str) -> DataFrame:
    """Each model's AUC for each kind of event."""
    rows = s.read(spark, sf, "events").where("value is not null").select("event_type", F.col("value").alias("a"), (F.col("user_id") % 50 / 50.0).alias("b"))
    by_model = rows.select("event_type", F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("score")) for m in ("a", "b")))))
    long = by_model.select("model", "score", F.inline(F.array(*(F.struct(F.lit(e).alias("event"), (F.col("event_type") == e).cast("int").alias("label")) for e in _EVENTS))))
    return evaluation.roc_auc(long, keys=["model", "event"]).select("model", "event", F.round("auc", 3).alias("auc"))


def _split(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Labelled documents in three parts by id, with three statistics."""
    docs = s.read(spark, sf, "documents").join(s.read(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.col("quality").alias("label"), F.log(1.0 + F.col("n_chars")).alias("size"), (F.col("n_chars") % 13 / 13.0).alias("noise"),
        (F.size(F.array_distinct(F.split("text", " "))) / F.size(F.split("text", " "))).alias("score"),
    )
    return {name: docs.where(F.pmod("doc_id", F.lit(3)) == k) for k, name in enumerate(("train", "val", "test"))}


@register()
def c_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The test scores of the strength that ranks the validation rows best; held against a plain regression in the tests."""
    parts = _split(spark, sf)
    assembler, scaler = learn.standardised(parts["train"], ["size", "noise", "score"])
    made = {k: scaler.transform(assembler.transform(v)) for k, v in parts.items()}
    model = learn.best_of(learn.balanced(made["train"]), made["val"].drop("score"))
    return learn.with_score(model, made["test"].drop("score")).select("doc_id", "label", F.round("score", 4).alias("score"))


@register()
def stacked_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A score joined with two statistics on the validation rows; held against a plain regression in the tests."""
    parts = _split(spark, sf)
    return scores.stacked(parts["val"], parts["test"], ["score", "size", "noise"]).select("doc_id", "label", F.round("score", 4).alias("score"))


_SHOWN = """x AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN o_totalprice * 1e6 WHEN 2 THEN o_totalprice * 1e5
      WHEN 3 THEN o_totalprice * 1e3 WHEN 4 THEN -o_totalprice * 20 WHEN 5 THEN o_totalprice / 1e3 ELSE o_totalprice END AS usd,
      (o_orderkey % 997) / 997.0 - 0.3 AS low FROM orders)"""
_FIXED = "format('{{:.{}f}}', round({}, {}))"
_SIZED = " ".join(f"WHEN abs(usd) >= {least} THEN {_FIXED.format(d, f'abs(usd) / {by}', d)} || '{sign}'" for least, by, d, sign in (("1e10", "1e9", 1, "B"), ("1e9", "1e9", 2, "B"), ("1e7", "1e6", 0, "M"), ("1e6", "1e6", 1, "M"), ("1e3", "1e3", 0, "K")))


@register(f"""WITH {_SHOWN} SELECT o_orderkey, CASE WHEN usd IS NULL THEN chr(8212) ELSE CASE WHEN usd < 0 THEN '-' ELSE '' END || '$' || CASE {_SIZED} ELSE {_FIXED.format(0, 'abs(usd)', 0)} END END AS money,
  {_FIXED.format(1, 'low * 100', 1)} || '%' AS pct, {_FIXED.format(3, 'low', 3)} AS num, '[' || {_FIXED.format(3, 'low', 3)} || ', ' || {_FIXED.format(3, 'low + 0.4', 3)} || ']' AS ci,
  low > 0 OR low + 0.4 < 0 AS significant, coalesce(abs(usd - 5000) <= 25, false) AS matches FROM x""")
def viewer_formats(spark: SparkSession, sf: str) -> DataFrame:
    x = s.read(spark, sf, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN o_totalprice * 1e6D WHEN 2 THEN o_totalprice * 1e5D WHEN 3 THEN o_totalprice * 1e3D WHEN 4 THEN -o_totalprice * 20 WHEN 5 THEN o_totalprice / 1e3D ELSE o_totalprice END AS usd", "(o_orderkey % 997) / 997.0D - 0.3D AS low")
    usd, low = F.col("usd"), F.col("low")
    return x.select(
        "o_orderkey", formats.money(usd).alias("money"), formats.pct(low).alias("pct"), formats.num(low).alias("num"), formats.interval(low, low + 0.4).alias("ci"),
        formats.significant(low, low + 0.4).alias("significant"), formats.revenue_matches(usd, F.lit(5000.0)).alias("matches"),
    )


@register(f"""SELECT round(accuracy_all * (answerable_n + unanswerable_n) / (answered_answerable * answerable_n + (1 - abstain_unanswerable) * unanswerable_n), 6) AS precision_when_answering
  FROM ({models.ORACLE_SQL["extraction_score"]})""")
def precision_when_answering(spark: SparkSession, sf: str) -> DataFrame:
    found = scores.precision_when_answering(models.QUERIES["extraction_score"](spark, sf))
    return found.select(F.round("precision_when_answering", 6).alias("precision_when_answering"))


@register("SELECT doc_id, strlen(text) AS bytes_raw, sha256(text) AS sha256, sha256(text) AS unpacked_sha256 FROM documents")
def raw_store(spark: SparkSession, sf: str) -> DataFrame:
    """Documents packed as they are stored, and unpacked again."""
    packed = sinks.pack(s.read(spark, sf, "documents").select("doc_id", "text"), "text")
    back = raw.unpack(packed, "packed")
    return back.select("doc_id", "bytes_raw", "sha256", F.sha2("packed", 256).alias("unpacked_sha256"))
