"""Text change, events around it, and raw documents to sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, text
from ..operators import change, novelty, sections
from ..operators import reports as findings
from . import standins as s

QUERIES, ORACLE_SQL, register = s.registrar()
_WORD = "'[a-z][a-z''-]*[a-z]|[a-z]'"


@register(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t[1:20], ' ') AS first_tokens, md5(array_to_string(t, ' ')) AS all_tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), {_WORD}) AS t FROM documents)")
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    made = s.read(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return made.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.slice("t", 1, 20), " ").alias("first_tokens"), F.md5(F.array_join("t", " ")).alias("all_tokens"))


_NEIGHBOURS = """conv AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations),
  terms AS (SELECT conv_id, turn, term, count(*) FILTER (side = 1) AS a, count(*) FILTER (side = 2) AS b FROM (
    SELECT conv_id, turn, 1 AS side, unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]*[a-z]|[a-z]')) AS term FROM conv WHERE prior IS NOT NULL UNION ALL
    SELECT conv_id, turn, 2, unnest(regexp_extract_all(lower(prior), '[a-z][a-z''-]*[a-z]|[a-z]')) FROM conv WHERE prior IS NOT NULL) GROUP BY ALL)"""


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    turns = Window.partitionBy("conv_id").orderBy("turn")
    return s.read(spark, sf, "conversations").select("conv_id", "turn", "text", F.lag("text").over(turns).alias("prior")).where("prior is not null")


@register("WITH " + _NEIGHBOURS + """ SELECT conv_id, turn, round(CASE WHEN sum(a * a) = 0 OR sum(b * b) = 0 THEN 'nan'
      ELSE sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) END, 6) AS similarity
    FROM terms GROUP BY ALL""")
def tf_cosine(spark: SparkSession, sf: str) -> DataFrame:
    out = change.pair_similarity(_neighbours(spark, sf), ["conv_id", "turn"], "text", "prior")
    return out.select("conv_id", "turn", F.round("sim_cosine", 6).alias("similarity"))


@register("WITH " + _NEIGHBOURS + " SELECT conv_id, turn, round(count(*) FILTER (a > 0 AND b > 0) / CAST(count(*) AS DOUBLE), 6) AS similarity FROM terms GROUP BY ALL HAVING sum(a) > 0 AND sum(b) > 0")
def jaccard(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _neighbours(spark, sf)
    value = text.jaccard(text.tokens(F.col("text")), text.tokens(F.col("prior")))
    return pairs.select("conv_id", "turn", F.round(value, 6).alias("similarity")).where(~F.isnan("similarity"))


_PAIRS = """found AS (SELECT a.accession, a.cik, a.fiscal_period_end, a.accepted_at, a.version_no, section, text FROM yearly_reports a
      JOIN yearly_sections USING (accession) WHERE status = 'found'),
  pairs AS (
    SELECT c.cik, c.section, c.accession, c.fiscal_period_end, c.accepted_at, p.accession AS prior_accession, p.fiscal_period_end AS prior_period_end,
      c.text, p.text AS prior_text
    FROM found c JOIN found p ON p.cik = c.cik AND p.section = c.section AND date_diff('day', p.fiscal_period_end, c.fiscal_period_end) BETWEEN 300
      AND 430 AND p.accepted_at < c.accepted_at
    WHERE c.version_no = 1 QUALIFY row_number() OVER (PARTITION BY c.accession, c.section ORDER BY p.accepted_at DESC, p.accession DESC) = 1)"""


@register(s.with_("yearly", more=_PAIRS) + "SELECT cik, section, accession, prior_accession, fiscal_period_end, prior_period_end, accepted_at FROM pairs", "fiscal_period_end", "prior_period_end", "accepted_at")
def pit_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return change.point_in_time_pairs(s.yearly_reports(spark, sf), s.yearly_sections(spark, sf)).drop("text", "prior_text")


_CHANGES = _PAIRS + """,
  docs AS (SELECT DISTINCT ON (accession, section) accession, section, text FROM (SELECT accession, section, text FROM pairs
    UNION ALL SELECT prior_accession, section, prior_text FROM pairs)),
  years AS (SELECT accession, year(min(accepted_at)) AS y FROM yearly_reports GROUP BY 1),
  counts AS (SELECT accession, section, y, term, count(*) AS tf FROM (SELECT accession, section, y, unnest(regexp_extract_all(lower(text),
    '[a-z][a-z''-]*[a-z]|[a-z]')) AS term FROM docs JOIN years USING (accession)) GROUP BY ALL),
  df AS (SELECT section, term, count(*) AS df FROM counts GROUP BY ALL),
  nd AS (SELECT section, count(*) AS n FROM docs GROUP BY 1),
  targets AS (SELECT DISTINCT section, year(accepted_at) AS ty FROM pairs),
  dfy AS (SELECT t.section, t.ty, c.term, count(*) AS dfy FROM targets t JOIN counts c ON c.section = t.section AND c.y < t.ty GROUP BY ALL),
  ny AS (SELECT t.section, t.ty, count(*) AS n_before FROM targets t JOIN (docs JOIN years USING (accession)) d ON d.section = t.section
    AND d.y < t.ty GROUP BY ALL),
  top AS (SELECT section, ty, max(ln((1 + n_before) / (1.0 + dfy)) + 1) AS top FROM dfy JOIN ny USING (section, ty) GROUP BY ALL),
  terms AS (
    SELECT accession, section, ty, term, sum(a) AS a, sum(b) AS b FROM (
      SELECT p.accession, p.section, year(p.accepted_at) AS ty, c.term, c.tf AS a, 0 AS b FROM pairs p JOIN counts c ON c.accession = p.accession
        AND c.section = p.section UNION ALL
      SELECT p.accession, p.section, year(p.accepted_at), c.term, 0, c.tf FROM pairs p JOIN counts c ON c.accession = p.prior_accession
        AND c.section = p.section) GROUP BY ALL),
  weighed AS (
    SELECT accession, section, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, n_before, ln((1 + n) / (1.0 + df)) + 1 AS w,
      coalesce(ln((1 + n_before) / (1.0 + dfy)) + 1, top, 0) AS wp
    FROM terms JOIN df USING (section, term) JOIN nd USING (section) LEFT JOIN ny USING (section, ty) LEFT JOIN dfy USING (section, ty, term) LEFT
      JOIN top USING (section, ty)),
  sims AS (
    SELECT accession, section, CAST(sum(a) AS BIGINT) AS words, CAST(sum(b) AS BIGINT) AS prior_words,
           CASE WHEN sum(a) = 0 OR sum(b) = 0 THEN 'nan' ELSE sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) END AS sim_cosine,
           CASE WHEN sum(a) = 0 OR sum(b) = 0 THEN 'nan' ELSE count(*) FILTER (a > 0 AND b > 0) / CAST(count(*) AS DOUBLE) END AS sim_jaccard,
           CASE WHEN sum(a) = 0 OR sum(b) = 0 THEN 'nan'
             ELSE sum(a * b * w * w) / (sqrt(sum(a * a * w * w)) * sqrt(sum(b * b * w * w))) END AS sim_tfidf,
           CASE WHEN sum(a) = 0 OR sum(b) = 0 OR max(n_before) IS NULL THEN 'nan'
             ELSE sum(a * b * wp * wp) / (sqrt(sum(a * a * wp * wp)) * sqrt(sum(b * b * wp * wp))) END AS sim_tfidf_pit
    FROM weighed GROUP BY ALL),
  section_changes AS (
    SELECT p.cik, p.section, p.accession, p.fiscal_period_end, p.accepted_at, p.prior_accession, p.prior_period_end, coalesce(words, 0) AS words,
      coalesce(prior_words, 0) AS prior_words,
           coalesce(sim_cosine, 'nan') AS sim_cosine, coalesce(sim_jaccard, 'nan') AS sim_jaccard, coalesce(sim_tfidf, 'nan') AS sim_tfidf,
             coalesce(sim_tfidf_pit, 'nan') AS sim_tfidf_pit
    FROM pairs p LEFT JOIN sims USING (accession, section))"""
_SIMS = ("sim_cosine", "sim_jaccard", "sim_tfidf", "sim_tfidf_pit")
_ROUNDED = ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE round({c}, 6) END AS {c}" for c in _SIMS)


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return change.section_changes(s.yearly_reports(spark, sf), s.yearly_sections(spark, sf))


def _rounded(df: DataFrame, columns=_SIMS) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.round(c, 6)) for c in columns})


@register(s.with_("yearly", more=_CHANGES) + f"SELECT cik, section, accession, fiscal_period_end, accepted_at, prior_accession, prior_period_end, words, prior_words, {_ROUNDED} FROM section_changes", "fiscal_period_end", "prior_period_end", "accepted_at")
def section_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_changes(spark, sf))


@register(s.with_("yearly", more=_CHANGES) + "SELECT accession, section, CASE WHEN isnan(sim_tfidf) THEN NULL ELSE round(sim_tfidf, 6) END AS sim_tfidf FROM section_changes")
def tfidf_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_changes(spark, sf)).select("accession", "section", "sim_tfidf")


@register(s.with_("yearly", more=_CHANGES) + "SELECT accession, section, CASE WHEN isnan(sim_tfidf_pit) THEN NULL ELSE round(sim_tfidf_pit, 6) END AS sim_tfidf_pit FROM section_changes")
def pit_tfidf_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_changes(spark, sf)).select("accession", "section", "sim_tfidf_pit")


@register(s.with_("yearly", more=_CHANGES) + """SELECT section, count(*) AS pairs, count(DISTINCT cik) AS firms, round(median(sim_cosine),
      3) AS median_cosine, round(median(sim_jaccard), 3) AS median_jaccard,
    round(median(sim_tfidf), 3) AS median_tfidf, round(100.0 * avg((sim_cosine > 0.9995)::int), 1) AS pct_near_verbatim FROM section_changes
      GROUP BY section""")
def change_summary(spark: SparkSession, sf: str) -> DataFrame:
    return findings.change_summary(_changes(spark, sf))


_EVENTS = """eights AS (SELECT user_id AS cik, '8-K' AS form, CASE event_type WHEN 'purchase' THEN '2.01,9.01' WHEN 'error' THEN '4.02'
      ELSE '7.01' END AS items,
    DATE '2001-02-01' + CAST(30 * (event_id % 50) AS INTEGER) AS filing_date FROM events),
  marked AS (SELECT sc.*, EXISTS (SELECT 1 FROM eights f JOIN yearly_reports p ON p.accession = sc.prior_accession WHERE f.cik = sc.cik
    AND f.form = '8-K' AND f.items LIKE '%2.01%'
    AND f.filing_date > CAST(p.accepted_at AS DATE) AND f.filing_date < CAST(sc.accepted_at AS DATE)) AS had_deal FROM section_changes sc)"""


def _eights(spark: SparkSession, sf: str) -> DataFrame:
    return s.read(spark, sf, "events").selectExpr(
        "user_id AS cik", "'8-K' AS form", "CASE event_type WHEN 'purchase' THEN '2.01,9.01' WHEN 'error' THEN '4.02' ELSE '7.01' END AS items",
        "date_add(DATE '2001-02-01', CAST(30 * (event_id % 50) AS INT)) AS filing_date",
    )


@register(s.with_("yearly", more=_CHANGES + "," + _EVENTS) + "SELECT accession, section, had_deal FROM marked")
def event_exists(spark: SparkSession, sf: str) -> DataFrame:
    return findings.with_event_between(_changes(spark, sf), s.yearly_reports(spark, sf), _eights(spark, sf)).select("accession", "section", "had_deal")


@register(s.with_("yearly", more=_CHANGES + "," + _EVENTS + """,
  long AS (SELECT section, had_deal, 'cosine' AS measure, sim_cosine AS sim FROM marked UNION ALL SELECT section, had_deal, 'jaccard', sim_jaccard
    FROM marked UNION ALL SELECT section, had_deal, 'tfidf', sim_tfidf FROM marked),
  ranked AS (SELECT *, rank() OVER (PARTITION BY section, measure ORDER BY sim DESC) + (count(*) OVER (PARTITION BY section, measure,
    sim) - 1) / 2.0 AS r FROM long WHERE sim IS NOT NULL AND NOT isnan(sim))""")
    + """SELECT section, measure, count(*) FILTER (had_deal) AS deal_pairs, count(*) FILTER (NOT had_deal) AS other_pairs,
    round((sum(r) FILTER (had_deal) - count(*) FILTER (had_deal) * (count(*) FILTER (had_deal) + 1) / 2.0) / (count(*) FILTER (had_deal) * count(*) FILTER (NOT had_deal)),
      3) AS auc FROM ranked GROUP BY section, measure""")  # fmt: skip
def event_auc(spark: SparkSession, sf: str) -> DataFrame:
    return findings.event_auc(_changes(spark, sf), s.yearly_reports(spark, sf), _eights(spark, sf))


@register(s.with_("yearly", more=_CHANGES + "," + _EVENTS) + """SELECT sc.cik, sc.section, sc.accession, sc.prior_accession,
      year(sc.fiscal_period_end) AS fy, round(sc.sim_tfidf, 6) AS sim_tfidf, sc.had_deal, md5(cur.text) AS text_md5, md5(pri.text) AS prior_md5
    FROM marked sc JOIN yearly_sections cur ON cur.accession = sc.accession AND cur.section = sc.section
      JOIN yearly_sections pri ON pri.accession = sc.prior_accession AND pri.section = sc.section WHERE NOT isnan(sc.sim_tfidf)""")
def deal_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = novelty.labelled_pairs(_changes(spark, sf), s.yearly_reports(spark, sf), _eights(spark, sf), s.yearly_sections(spark, sf)).where(~F.isnan("sim_tfidf"))
    return out.select("cik", "section", "accession", "prior_accession", F.col("fy").cast("long").alias("fy"), F.round("sim_tfidf", 6).alias("sim_tfidf"), "had_deal", F.md5("text").alias("text_md5"), F.md5("prior_text").alias("prior_md5"))


_BLOCK = "|".join(html.BLOCK_TAGS)
_COMMENTS = r"regexp_replace(html, '<!--.*?-->', '', 'gs')"
_DROP = _COMMENTS
for _tag in html.DROPPED:
    _DROP = rf"regexp_replace({_DROP}, '(?is)<{_tag}(?:|[^A-Za-z0-9_:-].*?)</{_tag}[ \t\r\n]*>', '', 'g')"
_TAGS = rf"regexp_replace(regexp_replace(regexp_replace({_DROP}, '(?i)</?(?:{_BLOCK})(?:[^A-Za-z0-9:_>-][^>]*)?>', chr(10), 'g'), '(?i)</?(?:td|th)(?:[^A-Za-z0-9:_>-][^>]*)?>', ' ', 'g'), '</?[A-Za-z][A-Za-z0-9:_-]*[^>]*>', '', 'g')"
_ENTITIES = f"replace(replace(replace(replace({_TAGS}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_LINES = f"list_filter(list_transform(string_split({_ENTITIES}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r\\f\\x0B\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'), ' ')), lambda x: x <> '')"


def _page_step(step) -> DataFrame:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return s.read(spark, sf, "pages").select("page_id", F.length(step(F.col("html"))).cast("long").alias("size"), F.md5(step(F.col("html"))).alias("digest"))

    return run


for _name, _step, _sql in (
    ("html_comments", html.drop_comments, _COMMENTS),
    ("html_drop", lambda c: html.drop_content(html.drop_comments(c)), _DROP),
    ("html_tags", lambda c: html.split_tags(html.drop_content(html.drop_comments(c))), _TAGS),
    ("html_entities", lambda c: html.resolve_entities(html.split_tags(html.drop_content(html.drop_comments(c)))), _ENTITIES),
):
    register(f"SELECT page_id, CAST(length(x) AS BIGINT) AS size, md5(x) AS digest FROM (SELECT page_id, {_sql} AS x FROM pages)", name=_name)(_page_step(_step))


@register(f"SELECT page_id, CAST(i - 1 AS BIGINT) AS line_no, lines[i] AS line FROM (SELECT page_id, {_LINES} AS lines FROM pages), unnest(range(1, len(lines) + 1)) AS t(i)")
def html_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = s.read(spark, sf, "pages").select("page_id", F.posexplode(html.to_lines(F.col("html").cast("binary"))).alias("line_no", "line"))
    return lines.withColumn("line_no", F.col("line_no").cast("long"))


# Documents with headings put before some of their lines.
_HEADED = """l AS (SELECT doc_id, i - 1 AS i, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1,
      len(ls) + 1)) AS t(i)),
  headed AS (SELECT doc_id, 2 * i AS k, CASE i % 5 WHEN 0 THEN 'Item ' || (1 + (doc_id + i) % 16) || CASE i % 3 WHEN 0 THEN 'A'
    ELSE '' END || '. Of the report'
      WHEN 2 THEN (7 + (doc_id + i) % 3) || 'A. Controls and Procedures' ELSE '7. Management''s discussion' END AS line FROM l WHERE i % 5 IN (0, 2,
        4)
    UNION ALL SELECT doc_id, 2 * i + 1, line FROM l),
  lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, line FROM headed),
  parsed AS (SELECT doc_id, i, line, regexp_extract(line,
    '(?i)^(?:part +i{1,3} *[,.:\\x{2013}\\x{2014}-]? *)?items? *([0-9]{1,2})(?:\\.?([a-cA-C]))?(?:[^A-Za-z0-9]|$)', ['n', 'l']) AS h,
      regexp_extract(line, '(?s)^([0-9]{1,2})(?:\\.?([a-cA-C]))?(?:$|[^A-Za-z0-9](.*)$)', ['n', 'l', 'rest']) AS b FROM lines
        WHERE length(line) <= 200),
  named AS (SELECT doc_id, i, h.n <> '' AS is_h, ltrim(h.n, '0') || upper(h.l) AS hi, ltrim(b.n, '0') || upper(b.l) AS bi,
    lower(trim(regexp_replace(b.rest, '^ *[.:-]? *', ''))) AS rest FROM parsed),
  order_ AS (SELECT unnest(['1','1A','1B','1C','2','3','4','5','6','7','7A','8','9','9A','9B','9C','10','11','12','13','14','15','16']) AS item,
    unnest(range(1, 24)) AS rank),
  heads AS (SELECT doc_id, i, item, rank FROM (SELECT doc_id, i, CASE WHEN is_h THEN hi WHEN bi = '9A' AND starts_with(rest,
    'controls and procedures') THEN '9A'
      WHEN bi = '7' AND starts_with(rest, 'management''s discussion') THEN '7' END AS item FROM named) JOIN order_ USING (item))"""


def _headed(spark: SparkSession, sf: str) -> DataFrame:
    docs = s.read(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("ls"))

    def line(x, i):
        item = F.concat(F.lit("Item "), (1 + (F.col("doc_id") + i) % 16).cast("string"), F.when(i % 3 == 0, "A").otherwise(""), F.lit(". Of the report"))
        controls = F.concat((7 + (F.col("doc_id") + i) % 3).cast("string"), F.lit("A. Controls and Procedures"))
        heading = F.when(i % 5 == 0, item).when(i % 5 == 2, controls).when(i % 5 == 4, F.lit("7. Management's discussion"))
        return F.when(heading.isNull(), F.array(x)).otherwise(F.array(heading, x))

    lined = docs.select("doc_id", F.explode(F.array(F.flatten(F.transform("ls", line)))).alias("lines"))
    return lined.select("doc_id", "lines", F.explode(F.array(sections.headings(F.col("lines")))).alias("found"))


@register("WITH " + _HEADED + " SELECT doc_id, CAST(i AS BIGINT) AS line, item, CAST(rank AS BIGINT) AS rank FROM heads")
def headings(spark: SparkSession, sf: str) -> DataFrame:
    return _headed(spark, sf).select("doc_id", F.inline("found")).select("doc_id", F.col("line").cast("long").alias("line"), "item", F.col("rank").cast("long").alias("rank"))


_EXTRACT = _HEADED + """,
  wanted AS (SELECT * FROM (VALUES ('risk_factors', '1A', 2), ('mdna', '7', 10)) v(section, item, r)),
  starts AS (SELECT doc_id, section, i AS st, (SELECT min(g.i) FROM heads g WHERE g.doc_id = h.doc_id AND g.i > h.i AND g.rank > r) AS en FROM heads h
    JOIN wanted USING (item)),
  sized AS (SELECT doc_id, section, st, en, coalesce((SELECT sum(length(line)) FROM lines x WHERE x.doc_id = starts.doc_id AND x.i > st AND x.i < en),
    0) AS size FROM starts),
  best AS (SELECT * FROM sized QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY CASE WHEN en IS NULL THEN -1 ELSE size END DESC,
    st) = 1),
  bodies AS (SELECT doc_id, section, st, en, coalesce((SELECT string_agg(line, chr(10) ORDER BY i) FROM lines x WHERE x.doc_id = best.doc_id
    AND x.i > st AND x.i < en), '') AS body,
      (SELECT line FROM lines x WHERE x.doc_id = best.doc_id AND x.i = st) AS title FROM best)
  SELECT doc_id, section, CASE WHEN st IS NULL THEN 'not_found' WHEN en IS NULL THEN 'unterminated' WHEN length(body) >= 1000 THEN 'found'
      WHEN regexp_matches(title || ' ' || body, '(?i)not[ \\n]+(?:required|applicable)|smaller[ \\n]+reporting[ \\n]+compan|omitted') THEN 'omitted'
      WHEN regexp_matches(body, '(?i)incorporated[ \\n]+(?:herein[ \\n]+)?by[ \\n]+reference') THEN 'by_reference' ELSE 'too_short' END AS status,
      CAST(st AS BIGINT) AS start_line, CAST(en AS BIGINT) AS end_line, md5(CASE WHEN en IS NULL THEN '' ELSE body END) AS body
  FROM (SELECT doc_id, section FROM documents, (SELECT DISTINCT section FROM wanted)) LEFT JOIN bodies USING (doc_id, section)"""


@register("WITH " + _EXTRACT)
def section_extract(spark: SparkSession, sf: str) -> DataFrame:
    headed = _headed(spark, sf)
    parts = F.array(*(F.struct(F.lit(n).alias("section"), sections.locate(F.col("lines"), F.col("found"), item).alias("p")) for n, item in sections.SECTIONS.items()))
    return headed.select("doc_id", F.inline(parts)).select(
        "doc_id", "section", "p.status", F.col("p.start_line").cast("long").alias("start_line"), F.col("p.end_line").cast("long").alias("end_line"), F.md5("p.text").alias("body")
    )


# Documents as reports of two sections: their letters, whole in one of them and cut short in the other; every fourth lacks the last heading.
_BODIES = r"""b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g')) AS b FROM documents
      WHERE doc_id % 3 <> 0),
  p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN b ELSE rtrim(substr(b, 1, 300)) END AS risk_factors, CASE
    WHEN doc_id % 2 = 0 THEN rtrim(substr(b, 1, 300)) ELSE b END AS mdna FROM b),
  r AS (SELECT doc_id, 4 + (risk_factors <> '')::int + (mdna <> '')::int + (doc_id % 4 <> 0)::int AS n_lines,
      23 + 18 + 4 + 18 + length(risk_factors) + length(mdna) + CASE WHEN doc_id % 4 <> 0 THEN 28 ELSE 0 END AS n_chars, section, CASE section
        WHEN 'mdna' THEN mdna ELSE risk_factors END AS body
    FROM p, (SELECT unnest(['risk_factors', 'mdna']) AS section))"""


@register(f"""WITH {_BODIES} SELECT doc_id, CAST(1 AS INTEGER) AS parser_version, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_chars AS BIGINT) AS n_chars, section,
    CASE WHEN section = 'mdna' AND doc_id % 4 = 0 THEN 'unterminated' WHEN length(body) >= 1000 THEN 'found' WHEN regexp_matches(body, '(?i)not (?:required|applicable)|smaller reporting compan|omitted') THEN 'omitted'
      WHEN regexp_matches(body, '(?i)incorporated (?:herein )?by reference') THEN 'by_reference' ELSE 'too_short' END AS status,
    CASE WHEN length(body) >= 1000 AND NOT (section = 'mdna' AND doc_id % 4 = 0) THEN md5(body) END AS digest FROM r""")
def incremental_parse(spark: SparkSession, sf: str) -> DataFrame:
    docs = s.read(spark, sf, "documents").select("doc_id", F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z ]", ""), " +", " ")).alias("b"))
    short, even = F.rtrim(F.substring("b", 1, 300)), F.col("doc_id") % 2 == 0
    last = F.when(F.col("doc_id") % 4 != 0, "<h2>Item 8. Financial Statements</h2>").otherwise("")
    page = F.concat(
        F.lit("<html><body><h2>Item 1A. Risk Factors..</h2><p>"), F.when(even, F.col("b")).otherwise(short), F.lit("</p><h2>Item 2. Properties</h2><p>none</p><h2>Item 7. Management</h2><p>"),
        F.when(even, short).otherwise(F.col("b")), F.lit("</p>"), last, F.lit("</body></html>"),
    )
    raw = docs.select("doc_id", page.cast("binary").alias("raw"))
    done = docs.where("doc_id % 3 = 0").select("doc_id", F.lit(sections.PARSER_VERSION).alias("parser_version"))
    rows = sections.parse(sections.unparsed(raw, done, ["doc_id"]), keys=["doc_id"])
    size = lambda c: F.col(c).cast("long").alias(c)
    return rows.select("doc_id", "parser_version", size("n_lines"), size("n_chars"), "section", "status", F.md5("text").alias("digest"))
