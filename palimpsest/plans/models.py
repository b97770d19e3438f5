"""Labels, extraction, novelty and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation, labels, learn, novelty
from . import standins as s

QUERIES, ORACLE_SQL, register = s.registrar()


@register(s.with_("filings", "headers", "stored", "reports", "facts", more="""k AS (SELECT * FROM annual_reports WHERE version_no = 1
      AND accepted_at + INTERVAL 365 DAY <= TIMESTAMP '2001-06-30'),
  eights AS (SELECT * FROM filings WHERE form = '8-K'),
  flt AS (SELECT accession, max(value) AS public_float FROM facts WHERE concept = 'EntityPublicFloat' AND unit = 'USD' AND value > 0 GROUP BY 1),
  lab AS (SELECT k.*, """ + ", ".join(
    f"EXISTS (SELECT 1 FROM eights f WHERE f.cik = k.cik AND f.items LIKE '%{item}%' AND f.filing_date BETWEEN CAST(k.accepted_at AS DATE) {a} AND CAST(k.accepted_at AS DATE) {b}) AS {prefix}{name}"
    for prefix, a, b in (("", "+ 1", "+ 365"), ("prior_", "- 365", "- 1")) for name, item in labels.EVENTS.items()
) + " FROM k)") + """SELECT l.accession, l.cik, year(fiscal_period_end) AS fy, CASE WHEN year(fiscal_period_end) <= 2017 THEN 'train'
      WHEN year(fiscal_period_end) <= 2019 THEN 'val' ELSE 'test' END AS split,
    f.public_float IS NOT NULL AS has_float, round(ln(1 + coalesce(f.public_float, 0)), 6) AS log_float, bankruptcy OR restatement
      OR auditor_change AS label, bankruptcy, restatement, auditor_change,
    prior_bankruptcy OR prior_restatement OR prior_auditor_change AS prior_event FROM lab l LEFT JOIN flt f USING (accession)""")  # fmt: skip
def event_labels(spark: SparkSession, sf: str) -> DataFrame:
    first = s.reports(spark, sf).where("version_no = 1")
    out = labels.event_labels(first, s.filings(spark, sf), s.facts(spark, sf), F.expr("TIMESTAMP_NTZ '2001-06-30 00:00:00'"))
    return out.withColumn("log_float", F.round("log_float", 6))


@register(s.with_("facts", more="""periods AS (SELECT l_orderkey AS accession, CAST(max(l_shipdate) AS DATE) AS fiscal_period_end FROM lineitem GROUP BY 1)""")
    + """SELECT x.accession, x.concept, x.value AS revenue_usd FROM facts x JOIN periods a ON a.accession = x.accession AND x.period_end = a.fiscal_period_end
    WHERE x.concept IN ('Revenues', 'SalesRevenueNet') AND x.unit = 'USD' AND date_diff('day', x.period_start, x.period_end) BETWEEN 350 AND 380
    QUALIFY row_number() OVER (PARTITION BY x.accession ORDER BY x.concept, x.value DESC) = 1""")  # fmt: skip
def fact_preference(spark: SparkSession, sf: str) -> DataFrame:
    periods = s.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("accession")).agg(F.max("l_shipdate").cast("date").alias("fiscal_period_end"))
    return labels.stated_revenue(periods, s.facts(spark, sf))


@register(r"""WITH l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1,
      len(ls) + 1)) AS t(i)),
  near AS (SELECT *, max(regexp_matches(line, '(?i)(?:token|license|that )')::int) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 6 PRECEDING
    AND CURRENT ROW) AS near FROM l),
  kept AS (SELECT * FROM near WHERE near = 1 AND (regexp_matches(line, '[0-9]') OR length(line) <= 300)),
  sized AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    0) + length(line) > 8000 AS over_ FROM kept),
  cut AS (SELECT *, max(over_::int) OVER (PARTITION BY doc_id ORDER BY i) AS stopped FROM sized)
  SELECT d.doc_id, CAST(length(p) AS BIGINT) AS size, md5(p) AS digest FROM (SELECT d.doc_id, coalesce((SELECT string_agg(line, chr(10) ORDER BY i)
    FROM cut c WHERE c.doc_id = d.doc_id AND stopped = 0), '') AS p FROM documents d) d""")  # fmt: skip
def passage(spark: SparkSession, sf: str) -> DataFrame:
    made = labels.passage(F.col("text"), mention=r"(?i)(?:token|license|that )")
    docs = s.read(spark, sf, "documents").select("doc_id", F.explode(F.array(made)).alias("p"))
    return docs.select("doc_id", F.length("p").cast("long").alias("size"), F.md5("p").alias("digest"))


_PROSE = """prose AS (SELECT o_orderkey, o_totalprice * CASE o_orderkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1 ELSE 1000000 END AS usd,
      CASE o_orderkey % 6
    WHEN 0 THEN 'Total revenues were $' || format('{:,.2f}', o_totalprice) || ' million for the year'
      WHEN 1 THEN '(in thousands)' || chr(10) || 'Net sales ' || format('{:,.1f}', o_totalprice) || ' and more'
    WHEN 2 THEN 'unknown' WHEN 3 THEN 'Revenue rose to ' || format('{:,.0f}', o_totalprice) || ' billion dollars' WHEN 4 THEN 'No figure here'
      ELSE 'about ' || format('{:,.2f}', o_totalprice) || ' thousand million' END AS text FROM orders)"""


def _prose(spark: SparkSession, sf: str) -> DataFrame:
    number = lambda d: f"format_number(o_totalprice, {d})"
    return s.read(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_totalprice * CASE o_orderkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1 ELSE 1000000 END AS usd",
        f"""CASE o_orderkey % 6 WHEN 0 THEN concat('Total revenues were $', {number(2)}, ' million for the year') WHEN 1 THEN concat('(in thousands)', chr(10), 'Net sales ', {number(1)}, ' and more')
        WHEN 2 THEN 'unknown' WHEN 3 THEN concat('Revenue rose to ', {number(0)}, ' billion dollars') WHEN 4 THEN 'No figure here' ELSE concat('about ', {number(2)}, ' thousand million') END AS text""",
    )


_ANSWER = r"""CASE WHEN starts_with(lower(trim(text)), 'unknown') OR regexp_extract(text, '[0-9][0-9,]*(?:\.[0-9]+)?') = '' THEN NULL ELSE
    CAST(replace(regexp_extract(text, '[0-9][0-9,]*(?:\.[0-9]+)?'), ',', '') AS DOUBLE) * CASE WHEN contains(tail, 'billion') THEN 1e9 ELSE 1 END * CASE WHEN contains(tail, 'million') THEN 1e6 ELSE 1 END * CASE WHEN contains(tail, 'thousand') THEN 1e3 ELSE 1 END END"""
_TAIL = r"(SELECT *, substr(regexp_extract(lower(trim(text)), '(?s)[0-9][0-9,]*(?:\.[0-9]+)?(.*)$', 1), 1, 12) AS tail FROM prose)"


@register(f"WITH {_PROSE} SELECT o_orderkey, round({_ANSWER}, 2) AS answer FROM {_TAIL}")
def answer_parser(spark: SparkSession, sf: str) -> DataFrame:
    return _prose(spark, sf).select("o_orderkey", F.round(text.parse_answer(F.col("text")), 2).alias("answer"))


_EXTRACTED = r"""extracted AS (SELECT *, CASE WHEN number = '' THEN NULL ELSE CAST(replace(number, ',', '') AS DOUBLE) * CASE coalesce(nullif(word,
      ''), note) WHEN 'billion' THEN 1e9 WHEN 'million' THEN 1e6 WHEN 'thousand' THEN 1e3 ELSE 1 END END AS prediction FROM (
    SELECT *, regexp_extract(text, '(?i)(?:total\s+(?:net\s+)?revenues?|net\s+revenues?|total\s+net\s+sales|net\s+sales|revenues?)[^$0-9]{0,80}\$?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(billion|million|thousand)?',
      1) AS number,
      lower(regexp_extract(text, '(?i)(?:total\s+(?:net\s+)?revenues?|net\s+revenues?|total\s+net\s+sales|net\s+sales|revenues?)[^$0-9]{0,80}\$?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(billion|million|thousand)?',
        2)) AS word,
      lower(regexp_extract(text, '(?i)in\s+(thousand|million|billion)s', 1)) AS note FROM prose))"""


@register(f"WITH {_PROSE}, {_EXTRACTED} SELECT o_orderkey, round(prediction, 2) AS revenue FROM extracted")
def regex_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _prose(spark, sf).select("o_orderkey", F.round(text.extract_revenue(F.col("text")), 2).alias("revenue"))


_FORMS = "[" + ", ".join(f"CASE WHEN usd / {scale} >= 1 THEN regexp_replace(format('{{:.{d}f}}', usd / {scale}), '[^0-9.]', '', 'g') END" for scale in ("1.0", "1e3", "1e6", "1e9") for d in (0, 1, 2)) + "]"
_ANSWERABLE = f"list_has_any(list_transform(regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda x: replace(x, ',', '')), list_filter({_FORMS}, lambda x: x IS NOT NULL))"


@register(f"WITH {_PROSE} SELECT o_orderkey, {_ANSWERABLE} AS answerable FROM prose")
def answerable(spark: SparkSession, sf: str) -> DataFrame:
    return _prose(spark, sf).select("o_orderkey", text.is_answerable(F.col("text"), F.col("usd")).alias("answerable"))


@register(f"""WITH {_PROSE}, {_EXTRACTED}, scored AS (SELECT *, {_ANSWERABLE} AS answerable, coalesce(abs(prediction - usd) <= 0.005 * usd, false)::int AS ok, (prediction IS NOT NULL)::int AS given FROM extracted)
    SELECT count(*) FILTER (answerable) AS answerable_n, round(avg(ok) FILTER (answerable), 3) AS accuracy_answerable, round(avg(given) FILTER (answerable), 3) AS answered_answerable,
    count(*) FILTER (NOT answerable) AS unanswerable_n, round(avg(1 - given) FILTER (NOT answerable), 3) AS abstain_unanswerable, round(avg(ok), 3) AS accuracy_all FROM scored""")
def extraction_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = _prose(spark, sf).select(F.col("usd").alias("revenue_usd"), text.is_answerable(F.col("text"), F.col("usd")).alias("answerable"), text.extract_revenue(F.col("text")).alias("prediction"))
    return labels.extraction_scores(rows)


@register("""SELECT doc_id, least(len(p), 300) AS n, md5(array_to_string(p[1:300], chr(10))) AS digest FROM (SELECT doc_id,
      list_filter(string_split(text, chr(10)), lambda x: length(x) >= 200) AS p FROM documents)""")
def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    docs = s.read(spark, sf, "documents").select("doc_id", text.paragraphs(F.col("text")).alias("p"))
    return docs.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "\n")).alias("digest"))


@register("""WITH v AS (SELECT vec_id, label, vec_id % 7 + 1 AS weight, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  near AS (SELECT c.vec_id, c.label, c.weight, max(list_dot_product(c.e, p.e) / (sqrt(list_dot_product(c.e, c.e)) * sqrt(list_dot_product(p.e,
    p.e)))) AS near FROM v c JOIN v p ON p.label = c.label - 1 GROUP BY ALL)
  SELECT label, round(sum((1 - least(near, 1.0)) * weight) / sum(weight), 6) AS novelty, count(*) AS paragraphs FROM near GROUP BY label""")  # fmt: skip
def paragraph_novelty(spark: SparkSession, sf: str) -> DataFrame:
    v = s.read(spark, sf, "embeddings").select("vec_id", F.col("label").alias("label"), (F.col("vec_id") % 7 + 1).alias("weight"), "embedding")
    prior = v.select((F.col("label") + 1).alias("label"), "embedding")
    return novelty.novelty(v, prior, ["label"]).withColumn("novelty", F.round("novelty", 6))


@register("""WITH c AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS prior_text FROM conversations),
  p AS (SELECT conv_id, turn, unnest(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 40)) AS paragraph,
    generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 40), 1) - 1 AS place FROM c WHERE prior_text IS NOT NULL),
  q AS (SELECT conv_id, turn, unnest(list_filter(string_split(prior_text, chr(10)), lambda x: length(x) >= 40)) AS prior_paragraph,
    generate_subscripts(list_filter(string_split(prior_text, chr(10)), lambda x: length(x) >= 40), 1) AS k FROM c WHERE prior_text IS NOT NULL),
  w AS (SELECT *, list_distinct(regexp_extract_all(lower(paragraph), '[a-z]+')) AS a, list_distinct(regexp_extract_all(lower(prior_paragraph),
    '[a-z]+')) AS b FROM p JOIN q USING (conv_id, turn) WHERE place < 300 AND k <= 300),
  j AS (SELECT *, len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) AS overlap FROM w WHERE len(a) > 0 AND len(b) > 0)
  SELECT conv_id, turn, CAST(place AS BIGINT) AS place, md5(prior_paragraph) AS prior, round(overlap, 6) AS overlap FROM (SELECT * FROM j
    WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn, place ORDER BY overlap DESC, k) = 1) WHERE overlap >= 0.1
    AND overlap < 0.95""")  # fmt: skip
def edit_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    turns = Window.partitionBy("conv_id", "role").orderBy("turn")
    rows = s.read(spark, sf, "conversations").withColumn("prior_text", F.lag("text").over(turns)).where("prior_text is not null")
    out = novelty.edit_pairs(rows, ["conv_id", "turn"], least=0.1, size=40)
    return out.select("conv_id", "turn", F.col("place").cast("long").alias("place"), F.md5("prior_paragraph").alias("prior"), F.round("overlap", 6).alias("overlap"))


_SCORED = "scored AS (SELECT source, quality AS label, round(n_chars % 997 / 50.0, 1) AS score, n_chars % 10 AS other FROM documents JOIN labels USING (doc_id))"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = s.read(spark, sf, "documents").join(s.read(spark, sf, "labels"), "doc_id")
    return rows.selectExpr("source", "quality AS label", "round(n_chars % 997 / 50.0D, 1) AS score", "CAST(n_chars % 10 AS DOUBLE) AS other")


@register("WITH " + _SCORED + """, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored)
  SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives,
    round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)),
    6) AS auc FROM r""")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.roc_auc(_scored(spark, sf)).withColumn("auc", F.round("auc", 6))


@register("WITH " + _SCORED + """, g AS (SELECT score, count(*) AS n, sum(label) AS p FROM scored GROUP BY 1), c AS (SELECT *,
      sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER (ORDER BY score DESC) AS cp FROM g)
  SELECT round(sum(p * cp / CAST(cn AS DOUBLE)) / sum(p), 6) AS average_precision FROM c""")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.average_precision(_scored(spark, sf)).withColumn("average_precision", F.round("average_precision", 6))


_CUTS = [sum(0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)[: k + 1]) for k in range(8)]
_DRAWN = _SCORED + """, draws AS (SELECT unnest(range(0, 2000)) AS draw), u AS (SELECT DISTINCT source, draw,
      CAST('0x' || substr(md5(draw || ':' || source), 1, 8) AS UBIGINT) / 4294967296.0 AS u FROM scored, draws),
  m AS (SELECT source, draw, """ + " + ".join(f"(u >= {c!r})::int" for c in _CUTS) + " AS m FROM u)"  # fmt: skip


def _drawn_auc(column: str) -> str:
    return f"""SELECT draw, (sum(p * (before + (n + 1) / 2.0)) - sum(p) * (sum(p) + 1) / 2.0) / nullif(sum(p) * (sum(n) - sum(p)), 0) AS auc FROM (
      SELECT *, coalesce(sum(n) OVER (PARTITION BY draw ORDER BY {column} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
        SELECT draw, {column}, sum(m) AS n, sum(label * m) AS p FROM scored JOIN m USING (source) WHERE m > 0 GROUP BY ALL)) GROUP BY draw"""


@register(f"WITH {_DRAWN} SELECT count(*) AS draws, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high FROM ({_drawn_auc('score')}) WHERE auc IS NOT NULL")
def cluster_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.cluster_bootstrap(_scored(spark, sf), "source")
    return out.select("draws", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@register(f"WITH {_DRAWN} SELECT count(*) AS draws, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM (SELECT a.auc - b.auc AS x FROM ({_drawn_auc('score')}) a JOIN ({_drawn_auc('other')}) b USING (draw)) WHERE x IS NOT NULL")
def paired_difference(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.cluster_bootstrap(_scored(spark, sf), "source", other="other")
    return out.select("draws", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@register("""SELECT l_returnflag, round(skewness(l_extendedprice), 6) AS skew, round(kurtosis(l_extendedprice) + 3, 6) AS kurt FROM lineitem GROUP BY 1""")
def moments(spark: SparkSession, sf: str) -> DataFrame:
    skew, kurt = evaluation.moments(F.col("l_extendedprice"))
    return s.read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(skew, 6).alias("skew"), F.round(kurt, 6).alias("kurt"))


@register("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z''-]*[a-z]|[a-z]') AS w FROM documents),
  g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t),
  c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
  k AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.9 * (SELECT n FROM n)
    ORDER BY total DESC, term LIMIT 200000),
  w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1.0 + df)) + 1) AS w FROM c JOIN k USING (term), n)
  SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")  # fmt: skip
def tfidf_vectorizer(spark: SparkSession, sf: str) -> DataFrame:
    return learn.tfidf(s.read(spark, sf, "documents")).withColumn("weight", F.round("weight", 6))


@register()
def logistic(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a balanced logistic regression on three statistics; tested on separable data."""
    docs = s.read(spark, sf, "documents").join(s.read(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.col("quality").alias("label"), F.log(1.0 + F.col("n_chars")).alias("size"),
        (F.size(F.array_distinct(F.split("text", " "))) / F.size(F.split("text", " "))).alias("new"),
        (F.length(F.translate("text", "!*$%&#|", "")) / (F.length("text") + 1)).alias("plain"),
    )
    assembler, scaler = learn.standardised(docs, ["size", "new", "plain"])
    rows = learn.balanced(scaler.transform(assembler.transform(docs)))
    return learn.with_score(learn.logistic(rows), rows).select("doc_id", "label", F.round("score", 4).alias("score"))
