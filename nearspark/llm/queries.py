"""The registered queries: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nearspark.llm import bpe, covertree, decontaminate, minhash, mixing, oracles, pii, quality, secrets, shared, suffix_dedup, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _joined(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    chosen = F.col(spans) if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        _sha256(F.array_join("items", ",")).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).alias("longest_match"),
    )


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.work_dir(spark, "warc")
    warc.write_archive(warc.make_records(table(spark, sf_dir, "pages")), path)
    read = warc.parse_records(warc.read_archive(spark, path), keep=["payload_bytes"], payloads=False, ids="long")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), keep=["doc_id"])


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.find_duplicates(table(spark, sf_dir, "documents"), words=4)


def op5_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), keep=["doc_id"])
    return found.select(
        "doc_id",
        *[_count("secrets", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        _sha256(_joined("secrets", ("assign", "access", "hex"))).alias("base_sha256"),
        _joined("secrets").alias("spans"),
    )


#: The mix of the registered query: four domains of sources, English first.
WEIGHTS = {("domain0",): 4.0, ("domain1",): 3.0, ("domain2",): 2.0, ("domain3",): 1.0, ("*", "en"): 5.0, ("*", "fr"): 2.0, ("*", "de"): 2.0, ("*", "es"): 1.0}
BUDGET = 0.6


def domain() -> Column:
    """The domain of a source by its number."""
    return F.concat(F.lit("domain"), (F.regexp_extract("source", "[0-9]+", 0).try_cast("int") % 4).cast("string"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), BUDGET, WEIGHTS, domain(), keep=["doc_id", "lang", "source"])


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.find_duplicates(table(spark, sf_dir, "embeddings"))


def op8_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    machine = quality.fit_quality(documents, table(spark, sf_dir, "labels"), metadata=["n_chars"])
    return quality.score_quality(documents, machine, metadata=["n_chars"], keep=["doc_id"]).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id",
        *[_count("pii", kind).alias(f"n_{kind}") for kind in pii.BASE],
        _sha256(_joined("pii", pii.BASE)).alias("base_sha256"),
        _joined("pii").alias("spans"),
        F.size("pii").cast("long").alias("n_found"),
    )


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_warc_archive, op3_count_tokens, op4_near_duplicates, op5_find_secrets, op6_mix_sources, op7_near_vectors, op8_remove_repeats, op9_score_quality, op10_find_pii)}

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS digest FROM p),
m AS (SELECT digest, min(page_id) AS least FROM d GROUP BY digest)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(digest, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to
FROM d JOIN m USING (digest)
"""


def _level_sql(n: int, parent: str, path: str, weight: str, source: str, given: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    name = path.rsplit(", ", 1)[-1]
    return f"""
n{n} AS (SELECT *, {weight} AS weight, {given} AS given FROM (SELECT {path}, sum(capacity) AS capacity, sum(available) AS available FROM leaf GROUP BY {path}) {source}),
f{n} AS (SELECT *, capacity * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (given - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full
  FROM n{n} WINDOW w AS ({by} ORDER BY capacity / weight, {name})),
g{n} AS (SELECT {path}, CASE WHEN is_full THEN capacity ELSE weight * (given - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({by}))
    / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}) END AS share FROM f{n}),"""


_MIX_SQL = f"""
WITH docs AS (SELECT doc_id, lang, source, 'domain' || CAST(CAST(regexp_extract(source, '[0-9]+', 0) AS INT) % 4 AS VARCHAR) AS domain,
  CAST(len(regexp_extract_all(text, '{mixing.WORD}')) AS BIGINT) AS n_tokens FROM documents),
d AS (SELECT * FROM docs WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS available, CAST(sum(n_tokens) AS DOUBLE) * {mixing.MAX_EPOCHS} AS capacity FROM d GROUP BY ALL),
{_level_sql(0, "", "domain", "CASE domain WHEN 'domain0' THEN 4.0::DOUBLE WHEN 'domain1' THEN 3.0 WHEN 'domain2' THEN 2.0 ELSE 1.0 END", "", f"least(floor(CAST(sum(available) OVER () AS DOUBLE) * {BUDGET}::DOUBLE), sum(capacity) OVER ())")}
{_level_sql(1, "domain", "domain, lang", "CASE lang WHEN 'en' THEN 5.0::DOUBLE WHEN 'fr' THEN 2.0 WHEN 'de' THEN 2.0 ELSE 1.0 END", "JOIN g0 USING (domain)", "share")}
{_level_sql(2, "domain, lang", "domain, lang, source", "1.0::DOUBLE", "JOIN g1 USING (domain, lang)", "share")}
s AS (SELECT domain, lang, source, available, CAST(floor(share) AS BIGINT) AS allotted FROM leaf JOIN g2 USING (domain, lang, source)),
o AS (SELECT d.*, allotted // available AS whole, allotted % available AS room, md5('{mixing.SEED}|' || CAST(allotted // available AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR)) AS key
  FROM d JOIN s USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id RANGE UNBOUNDED PRECEDING) <= room AS inside FROM o)
SELECT doc_id, lang, source, domain, n_tokens, CAST(unnest(range(CAST(whole + CASE WHEN inside THEN 1 ELSE 0 END AS BIGINT))) AS INT) AS epoch FROM c
"""

#: DuckDB SQL for those whose results SQL can state at the size of whole tables.
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": oracles.contamination(decontaminate.WINDOW),
    "op2_warc_archive": _WARC_SQL,
    "op4_near_duplicates": oracles.near_duplicates(4),
    "op6_mix_sources": _MIX_SQL,
    "op7_near_vectors": oracles.near_vectors(0.93),
    "op8_remove_repeats": oracles.repeats(suffix_dedup.LENGTH, suffix_dedup.PASSAGE),
    "op10_find_pii": oracles.personal_data(pii.CONTEXT, *pii.SCORES["ssn"][1:]),
}
