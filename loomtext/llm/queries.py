"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import (
    decontamination,
    license_scan,
    neighbours,
    quality_rules,
    secret_scan,
    sentencepiece_codec,
    sharding,
    simhash,
    substring_dedup,
    token_alignment,
    toxicity,
    unigram_count,
    whitening,
)
from loomtext.llm.common import read_table
from loomtext.session import shared_path


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(
        read_table(spark, sf_dir, "documents"),
        schema="n_words long, n_removed long, kept_sha256 string",
        project=substring_dedup.Removal.digest,
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history arrives in two parts at a new ledger: what has the lower half of the ids, then all of it.

    The second run scans the contents alone that the first one left unseen; every row gets its findings from the ledger.
    """
    docs, ledger = read_table(spark, sf_dir, "documents"), shared_path(spark, "secret-ledger")
    middle = docs.agg(((F.min("doc_id") + F.max("doc_id")) / 2).alias("at")).first()["at"]
    secret_scan.update_ledger(docs.filter(F.col("doc_id") <= F.lit(middle)), ledger, run="first")
    return secret_scan.scan_documents(docs, ledger_path=ledger, run="second")


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = unigram_count.piece_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    return unigram_count.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    field = quality_rules.fit_field(quality_rules.training_sample(docs, read_table(spark, sf_dir, "labels")))
    return quality_rules.judge_documents(docs, field)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = sharding.assign_shards(read_table(spark, sf_dir, "documents"))
    return assigned.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(
        read_table(spark, sf_dir, "documents"),
        tokenizer_path("piece_bpe_32k.model"),
        schema="n_tokens long, ids_sha256 string, decoded_sha256 string, ends_sha256 string",
        project=sentencepiece_codec.digests,
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"), digest=True)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    chain = toxicity.fit_chain(toxicity.training_sample(docs, read_table(spark, sf_dir, "labels")))
    return toxicity.score_documents(docs, chain)


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(read_table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return token_alignment.alignment_report(read_table(spark, sf_dir, "documents"), a, b)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_count": op3_token_count,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontamination": op5_decontamination,
    "op6_simhash": op6_simhash,
    "op7_sharding": op7_sharding,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_license_scan": op9_license_scan,
    "op10_toxicity": op10_toxicity,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_token_alignment": op12_token_alignment,
    "op13_whitening": op13_whitening,
}

#: Lower-cases A-Z alone, as SQL's lower() would change other letters too.
SQL_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = f"""
WITH item AS (
  SELECT item_id, regexp_extract_all({SQL_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), gram AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, regexp_extract_all({SQL_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), place AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc, (SELECT DISTINCT n FROM gram) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, n, k, item_id FROM place JOIN gram USING (n, g)
), word AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id
), item_list AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN item_list USING (doc_id)
"""

OP1_SQL = """
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), place AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY array_to_string(w[k : k + 19], ' ') ORDER BY doc_id, k) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM doc WHERE len(w) >= 20)
), hit AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS p FROM place WHERE n > 1
), word AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM doc
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

#: Written out here, apart from the operator's rules: kind, pattern, group that counts, its least length.
OP2_PATTERNS = (
    ("assign", "(?i)(password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
)


def _op2_sql() -> str:
    def one(order: int, kind: str, pattern: str, group: int, least: int) -> str:
        return f"""SELECT doc_id, {order} AS o, '{kind}' AS kind, string_split_regex(t, '{pattern}') AS gaps,
            regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS gs, {least} AS least
          FROM doc WHERE regexp_matches(t, '{pattern}')"""

    return f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hit AS ({" UNION ALL ".join(one(k, *r) for k, r in enumerate(OP2_PATTERNS))}),
span AS (
  SELECT doc_id, o, kind, least, length(gs[i]) AS size, length(ms[i]) AS n,
    list_sum([length(x) FOR x IN gaps[1 : i]]) + coalesce(list_sum([length(x) FOR x IN ms[1 : i - 1]]), 0) AS b
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM hit)
), kept AS (
  SELECT doc_id, o, kind, b, concat(kind, ':', CAST(b AS BIGINT), ':', CAST(b + n AS BIGINT)) AS s FROM span WHERE size >= least
), by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nc, count(*) FILTER (kind = 'hex') AS nh,
    string_agg(s, ',' ORDER BY b, o) FILTER (kind IN ('assign', 'access', 'hex')) AS base, string_agg(s, ',' ORDER BY b, o) AS every
  FROM kept GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(na, 0) AS BIGINT) AS n_assign, CAST(coalesce(nc, 0) AS BIGINT) AS n_access, CAST(coalesce(nh, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM doc LEFT JOIN by_doc USING (doc_id)
"""


ORACLES = {"op1_substring_dedup": OP1_SQL, "op2_secret_scan": _op2_sql(), "op5_decontamination": OP5_SQL}
