"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskpark.llm.common import held_out, ship, table, work_dir

#: SimHash contract: words of a shingle, greatest number of differing bits of a link.
SHINGLE, RADIUS = 4, 4
#: The SentencePiece model, a file of the public tokenizers.
PIECES = "piece_bpe_32k.model"


def op1_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts -> held_out, lang_pred, score; see ``langid``."""
    from deskpark.llm import langid

    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts -> fingerprint (hex) and component_id; see ``simhash.near_duplicates``."""
    from deskpark.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), SHINGLE, RADIUS)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts -> held_out, score, predicted; see ``quality_classifier``."""
    from deskpark.llm import quality_classifier as q

    docs = table(spark, sf_dir, "documents")
    out = q.classify(docs, q.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (doc_id, item_id) of a benchmark item that a document leaks; see ``decontaminate.leaks``."""
    from deskpark.llm import decontaminate

    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts -> counts and digest of the base spans, and all spans; see ``pii.find``."""
    from deskpark.llm import pii

    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs)).withColumn("own", F.filter("spans", lambda s: s.base))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("own", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("own"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts, base_failed, kept and distances; see ``quality_rules.judge``."""
    from deskpark.llm import quality_rules

    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts -> n_tokens, ids, decoded_equal of the 32k piece model; see ``sentencepiece_hf``."""
    import public_tokenizers

    from deskpark.llm import sentencepiece_hf

    return sentencepiece_hf.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op8_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts -> packed files in ascending doc_id, read back: start, n_tokens, ids_crc32; see ``bitpack``."""
    import public_tokenizers

    from deskpark.llm import bitpack

    path = public_tokenizers.path("byte_bpe_50k.json")
    files = bitpack.write(table(spark, sf_dir, "documents"), path, 50257, work_dir(spark, "op8"))
    return bitpack.read(files)


#: (host, path, verdict) of the URL contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; see ``url_filters.judge``."""
    from deskpark.llm import url_filters

    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


OP5_SQL = """
WITH split AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM split),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
rules AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                        ('org', '/fr/', 'allow')) AS r(rule_host, rule_path, rule_verdict)),
ranked AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS n
  FROM urls LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, verdict FROM ranked WHERE n = 1
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, crc, shard of 24 and slot, and its shard of 25; see ``sharding.place``."""
    from deskpark.llm import sharding

    out = sharding.place(table(spark, sf_dir, "documents"), sharding.even_tree(3, 2, 4))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector projected on the four leading components of the distinct vectors; see ``whitening``."""
    from deskpark.llm import whitening

    out = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's form, root and counts; see ``spelling.variants``."""
    from deskpark.llm import spelling

    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text; see ``html_text.extract``."""
    from deskpark.llm import html_text

    return html_text.extract(table(spark, sf_dir, "pages"))


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict:
    return {name: _shipped(f) for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filters": OP5_SQL}
