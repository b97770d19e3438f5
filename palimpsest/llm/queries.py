"""The registered queries ``opN_<name>`` and their SQL.

Each applies one operator, with its production parameters, to its whole table and derives
the digest columns from the operator's outputs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cross_entropy, decontaminate, exact_dedup, language_crf, pii_crf, rule_ensemble, simhash, suffix_dedup, url_rules
from .common import held_out, table

URL_RULES = [
    url_rules.Rule("com", "/en/", "block"),
    url_rules.Rule("example.com", "/en/7", "allow"),
    url_rules.Rule("net", "/de/", "block"),
    url_rules.Rule("example.net", "/de/8", "block"),
    url_rules.Rule("org", "/es/", "block"),
]

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels"))
    return rule_ensemble.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii_crf.find_personal_data(docs, pii_crf.train())
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *map(count, pii_crf.KINDS),
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_crf.identify(docs.select("doc_id", "text"), language_crf.train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_windows(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("words").alias("n_words"),
        F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def bpe_digests(docs: DataFrame) -> DataFrame:
    """``doc_id`` with the digests of its token ids and of what they decode to."""
    tokenizer = bpe.Tokenizer(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    rows = tokenizer.decode(tokenizer.encode(docs, keep=["doc_id"]))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, url_rules.rules_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id", "kept")


def op10_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = cross_entropy.score(docs, cross_entropy.targets(labels))
    return found.select("doc_id", "is_target", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


QUERIES = {f.__name__: f for f in (op1_suffix_array, op2_exact_dedup, op3_rule_ensemble, op4_pii_crf, op5_language_crf, op6_decontaminate, op7_bpe, op8_url_rules, op9_simhash, op10_cross_entropy)}

ORACLE_SQL = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size,
               doc_id IS NOT DISTINCT FROM keep_id
                 AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept,
               text_sha256
        FROM d JOIN g USING (text_sha256)
    """,
    "op6_decontaminate": r"""
        WITH dw AS (
          SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents),
        iw AS (
          SELECT item_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark),
        win AS (
          SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i : i + 7], ' ') AS s
          FROM iw, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS t(i) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM win),
        hit AS (
          SELECT r, i, win.n, item_id
          FROM dw, sizes, unnest(range(1, len(w) - sizes.n + 2)) AS t(i)
          JOIN win ON win.n = sizes.n AND win.s = array_to_string(w[i : i + sizes.n - 1], ' ')),
        words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, n)) AS u(k) GROUP BY r),
        items AS (
          SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)
    """,
    "op8_url_rules": r"""
        WITH rest AS (
          SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
        parts AS (
          SELECT page_id,
                 translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
          FROM rest),
        judged AS (
          SELECT *, CASE
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
              WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/'
            END AS rule
          FROM parts)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IS NULL OR rule = 'example.com/en/7' THEN 'allow' ELSE 'block' END AS verdict
        FROM judged
    """,
    "op10_cross_entropy": r"""
        WITH ids AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
        d AS (
          SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id IN (SELECT doc_id FROM ids), false) AS is_target,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents),
        tok AS (SELECT r, is_target, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
        seq AS (SELECT r, is_target, word, coalesce(lag(word) OVER (PARTITION BY r ORDER BY i), '<s>') AS prev FROM tok),
        big AS (SELECT prev, word, count(*) FILTER (is_target) AS t, count(*) FILTER (NOT is_target) AS b FROM seq GROUP BY ALL),
        uni AS (SELECT word, sum(t) AS ut, sum(b) AS ub FROM big GROUP BY word),
        ctx AS (SELECT prev, sum(t) AS ct, sum(b) AS cb FROM big GROUP BY prev),
        size AS (SELECT (SELECT count(*) FROM uni) + 1 AS v, (SELECT sum(ut) FROM uni) AS nt, (SELECT sum(ub) FROM uni) AS nb),
        loss AS (
          SELECT prev, word, -ln((t + 10.0 * (ut + 1) / (nt + v)) / (ct + 10)) AS lt, -ln((b + 10.0 * (ub + 1) / (nb + v)) / (cb + 10)) AS lb
          FROM big JOIN uni USING (word) JOIN ctx USING (prev), size),
        means AS (SELECT r, avg(lt) AS lt, avg(lb) AS lb FROM seq JOIN loss USING (prev, word) GROUP BY r)
        SELECT doc_id, is_target, CAST(len(w) AS BIGINT) AS n_tokens, round(coalesce(lt, 0.0), 6) AS target_loss,
               round(coalesce(lb, 0.0), 6) AS background_loss, round(coalesce(lt - lb, 0.0), 6) AS score
        FROM d LEFT JOIN means USING (r)
    """,
}
