"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import centroids, hosts, licenses, lm, merkle, mixing, packing, periodic, quality, simhash, suffixes, toxicity, warc
from .text import held_out

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.strip()
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_simhash")
def op1(spark, sf_dir):
    """Near-duplicate class of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_packing")
def op3(spark, sf_dir):
    """Place of every piece of every document in a sequence."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op6_quality")
def op6(spark, sf_dir):
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ensemble = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, ensemble).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op8_mixing", """
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (
  SELECT doc_id, source, size,
    -ln((CAST(CAST('0x' || substr(md5('8|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5e0) / 4503599627370496e0)
      / greatest(0.1e0, 1 - 5 * CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS DOUBLE) / CAST(greatest(size, 1) AS DOUBLE)) AS key
  FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM d GROUP BY source),
p AS (
  SELECT *, coalesce(sum(2e0 * source_size) OVER (ORDER BY 2e0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before,
    sum(w) OVER (ORDER BY 2e0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s),
l AS (SELECT max(((SELECT CAST(sum(source_size) AS DOUBLE) FROM s) * 150 / 100 - before) / rest) AS level FROM p),
t AS (SELECT source, source_size, least(2e0 * source_size, w * level) AS target FROM s, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS start
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, round(target, 4) AS target,
  CAST(size * (epochs + CASE WHEN budget > 0 AND start + size / 2e0 <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
""")
def op8(spark, sf_dir):
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


@query("op10_quality_rules", """
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    row_number() OVER () AS rid FROM documents),
g AS (
  SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
n AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS m FROM g) WHERE m > 1),
q AS (SELECT rid, count(DISTINCT p) AS rep FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM n) GROUP BY rid),
f AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN q USING (rid)),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines AS failed FROM f),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (failed) AS DOUBLE) AS x FROM b GROUP BY source),
m AS (SELECT sum(n) AS sn, sum(x) / sum(n) AS mean, count(*) AS k, sum(x * x / n) AS xx FROM h),
v AS (SELECT *, least(1e6, greatest(1e0, mean * (1 - mean) / greatest(xx / sn - mean * mean - mean * (1 - mean) * (k - 1) / sn, 1e-12) - 1)) AS s FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (x + mean * s) / (n + s) <= 0.6e0 AS kept
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source, v
""")
def op10(spark, sf_dir):
    """Rule counts, base verdict and final verdict of every document."""
    judged = hosts.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    counts = [f"_counts.{c}" for c in hosts.COUNTS if c != "n_lines"]
    return judged.select("doc_id", *counts, "base_failed", "kept")

@query("op2_merkle")
def op2(spark, sf_dir):
    """Merkle fingerprints of every text and its edited text."""
    return merkle.compare_with_next(table(spark, sf_dir, "documents"))


@query("op9_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
""")
def op9(spark, sf_dir):
    """Records of the archives of all pages, written and read back."""
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_toxicity")
def op5(spark, sf_dir):
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op7_language_model")
def op7(spark, sf_dir):
    """Base and model log probability of every document."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


def document_paths(docs: DataFrame) -> DataFrame:
    """``doc_id, path, text``: documents as files of a tree of sources.

    Every fiftieth id is its directory's licence file, every thousandth that of the directory above.
    """
    d = F.col("doc_id")
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(d / 1000).cast("string"))
    leaf = F.concat_ws("/", top, F.floor(d / 50).cast("string"))
    name = F.when(d % 1000 == 0, F.concat_ws("/", top, F.lit("LICENSE.txt"))).when(d % 50 == 0, F.concat_ws("/", leaf, F.lit("LICENSE")))
    return docs.select("doc_id", F.coalesce(name, F.concat(leaf, F.lit("/"), d.cast("string"), F.lit(".txt"))).alias("path"), "text")


@query("op4_licenses")
def op4(spark, sf_dir):
    """Own or inherited licence of every document."""
    files = document_paths(table(spark, sf_dir, "documents"))
    return licenses.scan_files(files).drop("text")


@query("op11_periodic_runs")
def op11(spark, sf_dir):
    """Periodic runs of every document, with runs planted into a tenth of them."""
    return periodic.periodic_runs(table(spark, sf_dir, "documents"), planted=True)


@query("op12_suffix_array")
def op12(spark, sf_dir):
    """What is left of every document without the 100-byte strings that start earlier."""
    cleaned = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query("op13_centroids", centroids.clustering_sql())
def op13(spark, sf_dir):
    """Cluster of every usable embedding after ten rounds."""
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
