"""Registered queries of joins, counts, functions, files, SQL functions and streams, and their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from nearspark.functions import columns as C
from nearspark.functions import sql as functions_sql
from nearspark.operators import records as R
from nearspark.operators import search as S
from nearspark.plans import queries as Q
from nearspark.plans.options import SearchOptions
from nearspark.plans.queries import K, NAMES, PATTERN, WITH_N, reads, table
from nearspark.sources import fastx
from nearspark.streaming import search as streams


def _folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the session names for what all executors see; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="files-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Steps beyond a text that two edits at half a cost a letter allow, the cost, and the most letters that it is for.
OVERHANG, ALPHA, MOST = 5, 0.5, 6


def _dna(k: int = K, **more) -> SearchOptions:
    return SearchOptions(alphabet="dna", k=k, **more)


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(reads(spark, sf_dir, "benchmark", "item_id"), [("p", PATTERN)], _dna(rc=True), text_col="seq", keep=["item_id", "seq"])


def matched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search(reads(spark, sf_dir), [PATTERN], _dna(1, trace=False), text_col="seq", keep=["doc_id"])
    return R.semi_join(table(spark, sf_dir, "documents").select("doc_id", "lang"), found, "doc_id")


def unmatched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search(reads(spark, sf_dir), [PATTERN], _dna(1, trace=False), text_col="seq", keep=["doc_id"])
    return R.anti_join(table(spark, sf_dir, "documents").select("doc_id", "lang"), found, "doc_id")


def match_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with the columns of their patterns."""
    patterns = spark.createDataFrame(list(enumerate(NAMES)), "pattern_idx int, label string")
    return R.with_patterns(Q.search_many(spark, sf_dir), patterns)


def pattern_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of parts as patterns."""
    return R.pattern_summary(table(spark, sf_dir, "part").select("p_name"), "p_name")


def search_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As search_many, with texts dealt anew and a mode named."""
    found = S.search_many(table(spark, sf_dir, "part"), NAMES, SearchOptions(k=1, trace=False), partitions=8, search_mode="batch_texts", text_col="p_name", keep=["p_partkey"])
    return found.select("p_partkey", "pattern_idx", "text_end", "cost")


def file_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns from a file of lines; their ids are the numbers of the lines."""
    path = _folder(spark, "patterns")
    spark.createDataFrame([("\n\n".join(NAMES),)], "value string").coalesce(1).write.text(path)
    found = S.search(table(spark, sf_dir, "part"), fastx.read_patterns(spark, path), SearchOptions(k=1, trace=False), text_col="p_name", keep=["p_partkey"])
    return found.select("p_partkey", "pattern_id", "text_end", "cost")


def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search(reads(spark, sf_dir, "conversations", "conv_id"), [PATTERN], _dna(rc=True, trace=False), text_col="seq", keep=["conv_id"])
    return R.summary(found, "conv_id")


def encoded_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every end of two patterns and of their reverse complements in forward texts."""
    names = reads(spark, sf_dir, "part", "p_partkey", "p_name")
    found = S.search_encoded(names, [("a", PATTERN), ("b", PATTERN[::-1])], _dna(3, rc=True, trace=False), every=True, text_col="seq", keep=["p_partkey"])
    return found.select("p_partkey", "pattern_id", "strand", "text_end", "cost")


def long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As search_minima, each text cut into the work of several tasks."""
    found = S.search_long(reads(spark, sf_dir), [PATTERN], _dna(trace=False), text_col="seq", keep=["doc_id"], chunk=4096)
    return found.select("doc_id", "text_end", "cost")


def stream_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As search_minima, the table read as a stream whose matches are appended to files."""
    schema = table(spark, sf_dir, "documents").schema
    # a pattern of paths, for a stream takes no single file
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]").select("doc_id", Q.bases(F.col("text")).alias("seq"))
    found = streams.search_stream(rows, [PATTERN], _dna(trace=False), text_col="seq", keep=["doc_id"])
    path = _folder(spark, "stream")
    streams.start(found.select("doc_id", "text_end", "cost"), f"{path}/matches", f"{path}/progress").awaitTermination()
    return spark.read.parquet(f"{path}/matches")


def grouped_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches gathered by document and end, in the order of their costs."""
    found = S.search(reads(spark, sf_dir), [("p", PATTERN)], _dna(1), text_col="seq", keep=["doc_id"]).withColumn("anchor", F.expr("text_end div 100"))
    item = F.transform("alignments", lambda a: F.concat_ws(":", a["cost"], a["text_start"], a["text_end"], a["cigar"]))
    return R.grouped(found, "doc_id").select("doc_id", "strand", "anchor", F.array_join(item, " ").alias("alignments"))


def running_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = Q._event_costs(spark, sf_dir).select("user_id", "end", (F.col("cost") % 3 - 1).alias("delta"))
    return R.running_cost(deltas, ["user_id"], start=5)


def island_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local minima within each run of consecutive ends."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.pmod("l_orderkey", F.lit(1000)).alias("end")).agg((F.count("*") % 4).cast("int").alias("cost"))
    inside = rows.where("cost <= 1")
    runs = R.islands(rows, 1, ["l_suppkey"]).select(F.col("l_suppkey").alias("key"), "first_end", "last_end")
    marked = inside.join(runs, (F.col("l_suppkey") == F.col("key")) & F.col("end").between(F.col("first_end"), F.col("last_end")))
    return R.rightmost_minima(marked.select("l_suppkey", "first_end", "end", "cost"), 1, ["l_suppkey", "first_end"])


def letter_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and matches of characters and sequences, N among them."""
    seq = F.concat(F.lit("A"), "seq")
    first, last = F.substring("s", 2, 1), F.right("s", F.lit(1))
    rows = reads(spark, sf_dir, letters=WITH_N).select("doc_id", seq.alias("s")).where(F.length("s") > 1)
    ends = F.left("s", F.lit(4)), F.right("s", F.lit(4))
    return rows.select(
        "doc_id",
        F.md5(C.reverse_text("s").cast("binary")).alias("reverse_md5"),
        C.encode_char(first).cast("int").alias("iupac_code"),
        C.is_match(first, last).alias("iupac_match"),
        C.is_match(first, F.lower(last), "dna").alias("dna_match"),
        C.is_match(first, F.lower(last), "ascii").alias("ascii_match"),
        C.is_match(first, F.lower(last), "ascii_ci").alias("ascii_ci_match"),
        C.is_match_slice(*ends).alias("slice_match"),
        C.is_match_slice(*ends, "ascii").alias("ascii_slice_match"),
    )


def n_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of N, of sequences and of what every alignment of an end covers."""
    at = F.pmod("doc_id", F.lit(97)).cast("int")
    rows = reads(spark, sf_dir, letters=WITH_N)
    return rows.select("doc_id", F.floor(C.n_fraction("seq") * F.lit(1024)).cast("int").alias("n_share"), C.n_endpoint("seq", at, 16, 4, 0.05).alias("few_n"))


def overhang_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps beyond a text and their costs, in single precision."""
    m, k = F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("int")
    rows = table(spark, sf_dir, "lineitem").select(m.alias("m"), k.alias("k")).distinct()
    return rows.select(
        "m",
        "k",
        C.overhang_steps("m", "k", 0.3).alias("steps"),
        C.overhang_steps("m", "k", 0.3, 4).alias("steps_to_4"),
        C.overshoot_cost("k", "m", F.lit(20), 0.3).alias("overshoot"),
        C.prefix_value(F.col("m").cast("long"), F.col("k").cast("long"), 5).alias("prefix"),
    )


def fractional_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.fractional_k("p_name", 0.125).alias("k"), C.fractional_k("p_name", 3).alias("whole"))


def match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches as JSON, with strands as numbers and regions in the pattern's direction."""
    region = C.match_region("seq", letters="dna")
    return _matches(spark, sf_dir).select("item_id", C.strand_number().alias("strand_number"), region.alias("match_region"), C.match_text().alias("line"))


def table_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match table written as tab-separated lines and read again."""
    path = _folder(spark, "tsv")
    fastx.write_tsv(fastx.match_table(_matches(spark, sf_dir), "dna", text_id="item_id"), path)
    return spark.read.schema("pat_id string, text_id long, cost int, strand string, start int, end int, match_region string, cigar string").csv(path, sep="\t", header=True)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir)
    return rows.select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("text_id"), F.concat(F.lit("A"), "seq").alias("seq"))


def _read_again(found: DataFrame) -> DataFrame:
    return found.select("text_id", F.length("seq").alias("size"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"), F.md5(F.col("quality").cast("binary")).alias("quality_md5"))


def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as FASTA and read again."""
    path = _folder(spark, "fasta")
    fastx.write_records(_records(spark, sf_dir).withColumn("quality", F.lit(None).cast("string")), path)
    return _read_again(fastx.read_fasta(spark, path))


def fastq_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as FASTQ, qualities with @ and + among them, and read again."""
    path = _folder(spark, "fastq")
    fastx.write_records(_records(spark, sf_dir).withColumn("quality", F.translate("seq", "ACGT", "@+I>")), path)
    return _read_again(fastx.read_fastq(spark, path))


def sql_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search as a function of SQL, on both strands."""
    functions_sql.register(spark)
    rows = reads(spark, sf_dir, "benchmark", "item_id")
    return spark.sql(f"SELECT item_id, m.* FROM {{rows}} LATERAL VIEW inline(fuzzy_search(seq, '{PATTERN}', {K}, 'dna')) m", rows=rows)


def sql_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions on sequences as SQL calls them."""
    functions_sql.register(spark)
    rows = reads(spark, sf_dir, letters=WITH_N)
    columns = "md5(CAST(complement(seq) AS BINARY)) AS complement_md5, md5(CAST(revcomp(seq) AS BINARY)) AS revcomp_md5, valid_seq(seq || 'E') AS valid_e, valid_seq(seq) AS valid, n_frac(seq) > 0.1 AS many_n"
    return spark.sql(f"SELECT doc_id, {columns}, cigar_reverse(concat(doc_id, '=1X2D')) AS cigar FROM {{rows}}", rows=rows)


def overhang_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every end, with patterns that begin before a text or end after it at half a cost a letter."""
    options = SearchOptions(alphabet="iupac", k=K, trace=False, alpha=ALPHA, max_overhang=MOST)
    found = S.search_all(reads(spark, sf_dir), [PATTERN], options, text_col="seq", keep=["doc_id"])
    return found.select("doc_id", "text_end", "pattern_end", "cost")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        matched_documents, unmatched_documents, match_patterns, pattern_batch, search_batched, file_patterns, match_summary, encoded_ends, long_texts, stream_minima,
        grouped_matches, running_costs, island_minima, letter_functions, n_functions, overhang_functions, fractional_costs, match_lines, table_file,
        fasta_records, fastq_records, sql_matches, sql_sequences, overhang_ends,
    )
}

_HITS = f"WITH {Q._costs(Q._source('documents', 'doc_id'), PATTERN, 1)}"
_MANY = Q.ORACLE_SQL["search_many"]
_LABEL = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(NAMES))
_BACKWARDS = f"SELECT item_id AS id, reverse({Q._bases_sql('text')}) AS s FROM benchmark"


def _both_strands(forward: str, back: str) -> str:
    """Traced matches of ``benchmark`` on both strands: columns of a forward text and of a reversed one."""
    one = Q._trace_sql(Q._source("benchmark", "item_id"), PATTERN, K, forward)
    return f"SELECT * FROM ({one}) UNION ALL SELECT * FROM ({Q._trace_sql(_BACKWARDS, Q._COMPLEMENT['p'], K, back)})"


def _line(strand: str, start: str, end: str) -> str:
    """The JSON of a match."""
    return (
        f"""'{{"text_start":' || {start} || ',"text_end":' || {end} || ',"pattern_start":0,"pattern_end":{len(PATTERN)},"cost":' || cost || ',"strand":"{strand}","cigar":"' || {Q._CIGAR} || '"}}'"""
    )


def _row(strand: str, start: str, end: str, region: str) -> str:
    return f"""'p' AS pat_id, id AS text_id, CAST(cost AS INT) AS cost, '{strand}' AS strand, CAST({start} AS INT) AS "start", CAST({end} AS INT) AS "end", {region} AS match_region, {Q._CIGAR} AS cigar"""


#: Of a reversed text searched for the complement, the region in the pattern's direction.
_REGION = "substr(s, i + 1, stop - i)"
_REGION_BACK = f"translate({_REGION}, 'ACGT', 'TGCA')"


def _encoded_ends() -> str:
    parts = []
    for name, pattern in (("a", PATTERN), ("b", PATTERN[::-1])):
        for strand, wanted in (("+", pattern), ("-", pattern.translate(str.maketrans("ACGT", "TGCA"))[::-1])):
            parts.append(f"SELECT * FROM (WITH {Q._costs(Q._source('part', 'p_partkey', 'p_name'), wanted, 3)} SELECT id AS p_partkey, '{name}' AS pattern_id, '{strand}' AS strand, {Q._END} FROM c WHERE cost <= 3)")
    return " UNION ALL ".join(parts)


def _records_sql(quality: str) -> str:
    return f"SELECT 'doc ' || doc_id AS text_id, CAST(length(s) AS INT) AS size, md5(s) AS seq_md5, {quality} AS quality_md5 FROM (SELECT doc_id, 'A' || {Q._bases_sql('text')} AS s FROM documents)"


def _overhang_sql() -> str:
    """Letters before a text cost as ``before`` says, ends after it as the best alignment of what lies inside and the rest."""
    m, width = len(PATTERN), len(PATTERN) + K
    before = f"(CAST(floor(least(j, {MOST}) * {ALPHA}) AS BIGINT) + greatest(j - {MOST}, 0))"
    left = lambda pattern, size, text: f"list_min(list_transform(range(0, {size} + 1), lambda j: {before} + levenshtein(substr({pattern}, j + 1), {text})))"
    return f"""WITH {Q._costs(Q._source('documents', 'doc_id'), PATTERN, K)},
inside AS (SELECT id, i AS text_end, {m} AS pattern_end, CASE WHEN i > {width} THEN cost ELSE least(cost, {left(f"'{PATTERN}'", m, 'w')}) END AS cost FROM c JOIN c_w USING (id, n, i)),
prefixes AS (SELECT id, n, r, left('{PATTERN}', CAST({m} - r AS BIGINT)) AS p, s FROM c_t, (SELECT unnest(range(0, {m + 1})) AS r)),
last AS (SELECT id, n, r, least(list_min(list_transform(range(0, least(n, {width}) + 1), lambda q: levenshtein(p, right(s, q)))),
  CASE WHEN n > {width} THEN {m} ELSE {left('p', 'length(p)', f'left(s, {width})')} END) AS cost FROM prefixes),
after_ AS (SELECT id, n AS text_end, {m} - x AS pattern_end, min(last.cost + abs(r - x)) + CAST(floor(x * {ALPHA}) AS BIGINT) AS cost FROM last, (SELECT unnest(range(1, {OVERHANG + 1})) AS x) GROUP BY id, n, x)
SELECT id AS doc_id, CAST(text_end AS INT) AS text_end, CAST(pattern_end AS INT) AS pattern_end, CAST(cost AS INT) AS cost FROM (SELECT * FROM inside UNION ALL SELECT * FROM after_) WHERE cost <= {K}"""


_CODES = {"A": 1, "C": 2, "T": 4, "G": 8, "N": 15}
_CODE = "CASE {0} " + " ".join(f"WHEN '{x}' THEN {n}" for x, n in _CODES.items()) + " END"
_SLICE = " AND ".join(f"({_CODE.format(f'substr(s, {i}, 1)')} & {_CODE.format(f'substr(right(s, 4), {i}, 1)')}) > 0" for i in range(1, 5))
_COMPLEMENTS = "translate(s, 'ACGTN', 'TGCAN')"

ORACLE_SQL: dict[str, str] = {
    "matched_documents": f"{_HITS} SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT id FROM c WHERE cost <= 1)",
    "unmatched_documents": f"{_HITS} SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT id FROM c WHERE cost <= 1)",
    "match_patterns": f"SELECT *, CASE pattern_idx {_LABEL} END AS label FROM ({_MANY})",
    "pattern_batch": "SELECT count(p_name) AS n_queries, CAST(coalesce(max(strlen(p_name)), 0) AS INT) AS max_pattern_length FROM part",
    "search_batched": _MANY,
    "file_patterns": f"SELECT p_partkey, CAST(2 * pattern_idx + 1 AS VARCHAR) AS pattern_id, text_end, cost FROM ({_MANY})",
    "match_summary": f"SELECT CAST(sum(n) AS BIGINT) AS matches, count(DISTINCT conv_id) AS texts, count(*) AS ends FROM (SELECT conv_id, strand, place, sum(n) AS n FROM ({Q.ORACLE_SQL['search_rc']}) GROUP BY ALL)",
    "encoded_ends": _encoded_ends(),
    "long_texts": Q.ORACLE_SQL["search_minima"],
    "stream_minima": Q.ORACLE_SQL["search_minima"],
    "grouped_matches": f"""SELECT doc_id, '+' AS strand, CAST(text_end // 100 AS BIGINT) AS anchor, string_agg(cost || ':' || text_start || ':' || text_end || ':' || cigar, ' ' ORDER BY cost, text_start, text_end, cigar) AS alignments
FROM ({Q._trace_sql(Q._source('documents', 'doc_id'), PATTERN, 1, Q._match_sql('doc_id', '+'))}) GROUP BY ALL""",
    "running_costs": """WITH d AS (SELECT user_id, event_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 7 % 3 - 1 AS delta FROM events),
s AS (SELECT *, 5 + sum(delta) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cost FROM d)
SELECT user_id, event_id AS "end", CAST(delta AS INT) AS delta, CAST(cost AS BIGINT) AS cost, CAST(min(cost) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS least FROM s""",
    "island_minima": f"""WITH r AS (SELECT l_suppkey, l_orderkey % 1000 AS e, CAST(count(*) % 4 AS INT) AS cost FROM lineitem GROUP BY ALL),
g AS (SELECT *, e - row_number() OVER (PARTITION BY l_suppkey ORDER BY e) AS run FROM r WHERE cost <= 1),
c AS (SELECT (l_suppkey, first_end) AS id, l_suppkey, first_end, e AS i, cost, 0 AS n FROM (SELECT *, min(e) OVER (PARTITION BY l_suppkey, run) AS first_end FROM g)), {Q._minima('c', 1)}
SELECT id[1] AS l_suppkey, id[2] AS first_end, i AS "end", cost FROM c_hit""",
    "letter_functions": f"""WITH t AS (SELECT doc_id, 'A' || {Q._bases_sql('text', WITH_N)} AS s FROM documents),
u AS (SELECT *, substr(s, 2, 1) AS a, right(s, 1) AS b FROM t WHERE length(s) > 1)
SELECT doc_id, md5(reverse(s)) AS reverse_md5, CAST({_CODE.format('a')} AS INT) AS iupac_code, ({_CODE.format('a')} & {_CODE.format('b')}) > 0 AS iupac_match, a = b AS dna_match, a = lower(b) AS ascii_match, a = b AS ascii_ci_match,
  CASE WHEN length(s) < 4 THEN {_CODE.format('a')} IS NOT NULL AND left(s, 4) = right(s, 4) ELSE {_SLICE} END AS slice_match, left(s, 4) = right(s, 4) AS ascii_slice_match FROM u""",
    "n_functions": f"""WITH t AS (SELECT doc_id, {Q._bases_sql('text', WITH_N)} AS s, CAST(doc_id % 97 AS BIGINT) AS at_ FROM documents),
u AS (SELECT *, least(at_, length(s)) AS stop FROM t), v AS (SELECT *, substr(s, stop - least(12, stop) + 1, least(12, stop)) AS part FROM u)
SELECT doc_id, CASE WHEN length(s) = 0 THEN 0 ELSE CAST(floor(CAST((length(s) - length(replace(s, 'N', ''))) / length(s) AS FLOAT) * 1024) AS INT) END AS n_share,
  (length(part) - length(replace(part, 'N', ''))) * 20 <= 20 AS few_n FROM v""",
    "overhang_functions": """WITH t AS (SELECT DISTINCT CAST(l_quantity AS INT) AS m, CAST(l_linenumber AS INT) AS k FROM lineitem),
u AS (SELECT *, least(m, CAST(ceil((CAST(k AS FLOAT) + CAST(0.3 AS FLOAT)) / CAST(0.3 AS FLOAT)) AS INT)) AS steps FROM t)
SELECT m, k, steps, least(steps, 4) AS steps_to_4, CAST(k + floor(CAST(0.3 AS FLOAT) * CAST(greatest(m - 20, 0) AS FLOAT)) AS INT) AS overshoot,
  CAST(bit_count(m & 31) - bit_count(k & 31) AS INT) AS prefix FROM u""",
    "fractional_costs": "SELECT p_partkey, CAST(ceil(length(p_name) * 0.125) AS INT) AS k, CAST(3 AS INT) AS whole FROM part",
    "match_lines": _both_strands(
        f"id AS item_id, CAST(0 AS INT) AS strand_number, {_REGION} AS match_region, {_line('+', 'i', 'stop')} AS line",
        f"id AS item_id, CAST(1 AS INT) AS strand_number, {_REGION_BACK} AS match_region, {_line('-', '(n - stop)', '(n - i)')} AS line",
    ),
    "table_file": _both_strands(_row("+", "i", "stop", _REGION), _row("-", "n - stop", "n - i", _REGION_BACK)),
    "fasta_records": _records_sql("CAST(NULL AS VARCHAR)"),
    "fastq_records": _records_sql("md5(translate(s, 'ACGT', '@+I>'))"),
    "sql_matches": _both_strands(Q._match_sql("item_id", "+"), Q._match_sql("item_id", "-", start="n - stop", end="n - i")),
    "overhang_ends": _overhang_sql(),
    "sql_sequences": f"""WITH t AS (SELECT doc_id, {Q._bases_sql('text', WITH_N)} AS s FROM documents)
SELECT doc_id, md5({_COMPLEMENTS}) AS complement_md5, md5(reverse({_COMPLEMENTS})) AS revcomp_md5, false AS valid_e, true AS valid,
  CASE WHEN length(s) > 0 THEN (length(s) - length(replace(s, 'N', ''))) / length(s) ELSE 0 END > 0.1 AS many_n, '2D1X' || doc_id || '=' AS cigar FROM t""",
}
