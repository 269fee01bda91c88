"""The registered queries of the search operators, each over a whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nearspark.functions import columns as C
from nearspark.functions.pretty import pretty
from nearspark.operators import records as R
from nearspark.operators import search as S
from nearspark.operators.crispr import crispr
from nearspark.plans.options import SearchOptions
from nearspark.sources.fastx import match_table

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: What stands for each letter where bases are derived from prose: with and without N.
WITH_N = "ACGTCAGTCAGTACGTNCATGCGNAN"
BASES = "ACGTCAGTCAGTACGTGCATGCGTAC"

PATTERN, K = "GATTACAGTC", 2
BARCODE, BARCODE_K = "ACCTGAACGTTGCAGT", 5
URL = "example"
NAMES = ("small", "widgit", "blue bolt")
GUIDE, GUIDE_K = "ATCAGTGCACC", 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bases(text: Column, letters: str = BASES) -> Column:
    """A sequence of bases from the letters A-Z of a text."""
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, letters)


def reads(spark: SparkSession, sf_dir: str, name: str = "documents", id_col: str = "doc_id", text: str = "text", letters: str = BASES) -> DataFrame:
    return table(spark, sf_dir, name).select(id_col, bases(F.col(text), letters).alias("seq"))


def _dna(k: int = K, **more) -> SearchOptions:
    return SearchOptions(alphabet="dna", k=k, **more)


def search_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search(reads(spark, sf_dir), [PATTERN], _dna(trace=False), text_col="seq", keep=["doc_id"])
    return found.select("doc_id", "text_end", "cost")


def search_all_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search_all(table(spark, sf_dir, "pages"), [URL], SearchOptions(k=2, trace=False), text_col="url", keep=["page_id"])
    return found.select("page_id", "text_end", "cost")


def search_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = reads(spark, sf_dir, "benchmark", "item_id")
    found = S.search(texts, [PATTERN], _dna(3), text_col="seq", keep=["item_id", "seq"])
    region = F.substring("seq", F.col("text_start") + 1, F.col("text_end") - F.col("text_start"))
    return found.select("item_id", "text_start", "text_end", "cost", "cigar", region.alias("match_region"))


def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search_many(table(spark, sf_dir, "part"), NAMES, SearchOptions(k=1, trace=False), text_col="p_name", keep=["p_partkey"])
    return found.select("p_partkey", "pattern_idx", "text_end", "cost")


def search_ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search(table(spark, sf_dir, "pages"), ["EXAMPLE.COM"], SearchOptions(alphabet="ascii_ci", k=2, trace=False), text_col="url", keep=["page_id"])
    return found.select("page_id", "text_end", "cost")


def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search_best(reads(spark, sf_dir, "benchmark", "item_id"), [BARCODE], _dna(BARCODE_K, trace=False), text_col="seq", keep=["item_id"])
    return found.select("item_id", "text_end", "cost")


def best_match_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search_best(reads(spark, sf_dir), [BARCODE], _dna(BARCODE_K, trace=False), text_col="seq", keep=["doc_id"])
    return found.select("doc_id", "text_end", "cost")


def cost_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search(reads(spark, sf_dir, "conversations", "conv_id"), [PATTERN], _dna(trace=False), text_col="seq", keep=[])
    return R.histogram(found, K)


def cost_histogram_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(search_minima(spark, sf_dir), K)


def filter_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filter_records(reads(spark, sf_dir), [PATTERN], _dna(1), text_col="seq").select("doc_id")


def filter_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filter_records(reads(spark, sf_dir), [PATTERN], _dna(1), invert=True, text_col="seq").select("doc_id")


def search_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search_ranges(table(spark, sf_dir, "pages"), [URL], SearchOptions(k=3), text_col="url", keep=["page_id"])
    return found.select("page_id", "first_end", "last_end", "cost")


def search_rc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search(reads(spark, sf_dir, "conversations", "conv_id"), [PATTERN], _dna(rc=True, trace=False), text_col="seq", keep=["conv_id"])
    return found.groupBy("conv_id", "strand", F.coalesce("text_end", "text_start").alias("place"), "cost").agg(F.count("*").alias("n"))


def crispr_off_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crispr(reads(spark, sf_dir, "benchmark", "item_id"), [GUIDE], GUIDE_K, 0.2, keep=["item_id"])
    return found.groupBy("item_id", "strand", F.when(F.col("strand") == "+", F.col("text_end")).otherwise(F.col("text_start")).alias("place"), "cost").agg(F.count("*").alias("n"))


def crispr_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crispr(reads(spark, sf_dir), [GUIDE], GUIDE_K, 0.2, keep=["doc_id"])
    return found.groupBy("doc_id", "strand", F.when(F.col("strand") == "+", F.col("text_end")).otherwise(F.col("text_start")).alias("place"), "cost").agg(F.count("*").alias("n"))


def all_vs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), bases(F.translate("n_name", "0123456789_", "bdfhjlnprtv"), BASES).alias("seq"))
    return R.all_vs_all(names, _dna(2))


def sequence_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    rows = reads(spark, sf_dir, letters=WITH_N)
    return rows.select(
        "doc_id",
        F.md5(C.complement(seq).cast("binary")).alias("complement_md5"),
        F.md5(C.reverse_complement(seq).cast("binary")).alias("revcomp_md5"),
        C.valid_seq(seq, "dna").alias("valid_dna"),
        C.valid_seq(seq).alias("valid_iupac"),
        C.n_count(seq).alias("n_count"),
        C.pam_match(seq, F.length(seq), "NGG").alias("ends_in_pam"),
    )


def n_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches among bases and N, few N allowed; IUPAC letters are beyond SQL's edit distance."""
    found = S.search(reads(spark, sf_dir, letters=WITH_N), [BARCODE], SearchOptions(alphabet="iupac", k=4, rc=True, max_n_frac=0.2), text_col="seq", keep=["doc_id"])
    return found.select("doc_id", "strand", "text_start", "text_end", "cost", "cigar")


def search_overhang(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = SearchOptions(alphabet="iupac", k=2, rc=True, alpha=0.5, max_overhang=6)
    found = S.search(reads(spark, sf_dir), [PATTERN], options, text_col="seq", keep=["doc_id"])
    return found.drop("pattern_idx", "pattern_id")


def search_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search_all_alignments(reads(spark, sf_dir), [PATTERN], _dna(rc=True), text_col="seq", keep=["doc_id"])
    return found.select("doc_id", "strand", "anchor", "text_start", "text_end", "cost", "cigar")


def search_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = [("a", PATTERN), ("b", PATTERN[::-1])]
    found = S.search_encoded(reads(spark, sf_dir), patterns, _dna(rc=True), text_col="seq", keep=["doc_id"])
    return found.drop("pattern_idx")


def end_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends that are followed by the letter G in the searched text."""
    follows = F.col("search_text").substr(F.col("search_end") + 1, F.lit(1)) == F.lit(b"G")
    found = S.search_where(reads(spark, sf_dir), [PATTERN], _dna(rc=True), follows, text_col="seq", keep=["doc_id"])
    return found.drop("pattern_idx", "pattern_id")


def sam_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search(reads(spark, sf_dir, "benchmark", "item_id"), [("p", PATTERN)], _dna(rc=True), text_col="seq", keep=["item_id", "seq"])
    return match_table(found, "dna", sam=True, text_id="item_id")


def pretty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search(reads(spark, sf_dir, "benchmark", "item_id"), [("p", PATTERN)], _dna(rc=True), text_col="seq", keep=["item_id", "seq"])
    return pretty(found, {"p": PATTERN.encode()}, colour=False).select("item_id", "strand", "text_start", "pretty")


def alignment_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search(reads(spark, sf_dir), [PATTERN], _dna(rc=True), text_col="seq", keep=["doc_id"])
    path = C.alignment_path()
    return found.select("doc_id", "strand", "text_start", F.to_json(path).alias("path"), C.net_insertions("cigar").alias("net_insertions"), C.reverse_cigar("cigar").alias("reverse_cigar"))


def _event_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of ends: the number in an event's props, of each user in the order of events."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"))
    return rows.select("user_id", F.col("event_id").alias("end"), F.pmod("k", F.lit(7)).cast("int").alias("cost"))


def window_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rightmost_minima(_event_costs(spark, sf_dir), 3, ["user_id"])


def window_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.pmod("l_orderkey", F.lit(1000)).alias("end")).agg((F.count("*") % 4).cast("int").alias("cost"))
    return R.islands(costs, 1, ["l_suppkey"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        search_minima, search_all_ends, search_trace, search_many, search_ignore_case, best_match, cost_histogram, filter_matching, filter_unmatched,
        search_ranges, search_rc, crispr_off_targets, all_vs_all, sequence_functions, n_limited, search_overhang, search_alignments, search_encoded,
        end_predicate, sam_table, pretty_lines, alignment_paths, window_minima, window_islands, best_match_documents, cost_histogram_documents, crispr_documents,
    )
}


def _bases_sql(text: str, letters: str = BASES) -> str:
    return f"translate(lower(regexp_replace({text}, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{letters}')"


def _costs(source: str, pattern: str, k: int, name: str = "c") -> str:
    """CTEs up to ``name`` (id, n, i, cost) from a query of (id, s): the cost of each end by trying all starts that matter."""
    width = len(pattern) + k
    return f"""{name}_t AS (SELECT id, s, length(s) AS n FROM ({source}) WHERE length(s) > 0),
{name}_e AS (SELECT id, s, n, unnest(range(0, n + 1)) AS i FROM {name}_t),
{name}_w AS (SELECT id, n, i, substr(s, greatest(i - {width}, 0) + 1, least(i, {width})) AS w FROM {name}_e),
{name} AS (SELECT id, n, i, list_min(list_transform(range(0, length(w) + 1), lambda q: levenshtein('{pattern}', right(w, q)))) AS cost FROM {name}_w)"""


def _minima(name: str, k: int) -> str:
    return f"""{name}_s AS (SELECT *, nullif(sign(cost - lag(cost) OVER w), 0) AS step, lead(cost) OVER w AS following FROM {name} WINDOW w AS (PARTITION BY id ORDER BY i)),
{name}_m AS (SELECT *, coalesce(last_value(step IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING), -1) AS way FROM {name}_s),
{name}_hit AS (SELECT id, n, i, cost FROM {name}_m WHERE cost <= {k} AND way < 0 AND (following IS NULL OR following > cost))"""


def _source(name: str, key: str, text: str = "text") -> str:
    return f"SELECT {key} AS id, {_bases_sql(text)} AS s FROM {name}"


_PAIRS = ("ACGT", "TGCA")
_COMPLEMENT = {x: PATTERN.translate(str.maketrans(*_PAIRS)) if x == "p" else GUIDE.translate(str.maketrans(*_PAIRS)) for x in "pg"}
_END = "CAST(i AS INT) AS text_end, CAST(cost AS INT) AS cost"
_CONVERSATIONS = f"SELECT row_number() OVER () AS id, {_bases_sql('text')} AS s FROM conversations"
_DOCUMENTS = f"WITH {_costs(_source('documents', 'doc_id'), PATTERN, K)}, {_minima('c', K)}"
_URLS = f"WITH {_costs('SELECT page_id AS id, url AS s FROM pages', URL, 3)}"

_part_sql = []
for _i, _name in enumerate(NAMES):
    _part_sql.append(f"SELECT * FROM (WITH {_costs('SELECT p_partkey AS id, p_name AS s FROM part', _name, 1)}, {_minima('c', 1)} SELECT id AS p_partkey, CAST({_i} AS INT) AS pattern_idx, {_END} FROM c_hit)")


_CIGAR = "list_aggregate(list_transform(regexp_extract_all(ops, '=+|X+|D+|I+'), lambda r: CAST(length(r) AS VARCHAR) || left(r, 1)), 'string_agg', '')"


def _trace_sql(source: str, pattern: str, k: int, columns: str, ends: str = "true") -> str:
    """``columns`` of (id, n, s, i, stop, cost, ops) for minima at ``ends``, by walking back from each end.

    Matches are tried first, then substitutions, text and pattern characters.
    """
    cell = lambda j, i: f"CASE WHEN {j} = 0 THEN 0 ELSE list_min(list_transform(range(0, least({i}, {j} + {k}) + 1), lambda q: levenshtein(left('{pattern}', CAST({j} AS BIGINT)), substr(s, {i} - q + 1, q)))) END"
    return f"""WITH RECURSIVE {_costs(source, pattern, k)}, {_minima('c', k)},
walk AS (
  SELECT h.id, t.n, h.i AS stop, h.cost, t.s, h.i AS i, CAST({len(pattern)} AS BIGINT) AS j, h.cost AS g, '' AS ops FROM c_hit h JOIN c_t t USING (id) WHERE {ends}
  UNION ALL
  SELECT id, n, stop, cost, s, i - CASE WHEN op = 'I' THEN 0 ELSE 1 END, j - CASE WHEN op = 'D' THEN 0 ELSE 1 END, g - CASE WHEN op = '=' THEN 0 ELSE 1 END, op || ops FROM (
    SELECT *, CASE WHEN i > 0 AND substr('{pattern}', j, 1) = substr(s, i, 1) AND {cell('(j - 1)', '(i - 1)')} = g THEN '='
      WHEN i > 0 AND {cell('(j - 1)', '(i - 1)')} = g - 1 THEN 'X' WHEN i > 0 AND {cell('j', '(i - 1)')} = g - 1 THEN 'D' ELSE 'I' END AS op
    FROM walk WHERE j > 0))
SELECT {columns} FROM walk WHERE j = 0"""


def _match_sql(id_col: str, strand: str, more: str = "", start: str = "i", end: str = "stop") -> str:
    """The columns of a match that has no overhang."""
    return f"id AS {id_col}, {more}CAST({start} AS INT) AS text_start, CAST({end} AS INT) AS text_end, CAST(0 AS INT) AS pattern_start, CAST({len(PATTERN)} AS INT) AS pattern_end, CAST(cost AS INT) AS cost, '{strand}' AS strand, {_CIGAR} AS cigar"


def _encoded_sql() -> str:
    """Two patterns and their reverse complements in forward texts."""
    parts = []
    for name, pattern in (("a", PATTERN), ("b", PATTERN[::-1])):
        for strand, wanted in (("+", pattern), ("-", pattern.translate(str.maketrans(*_PAIRS))[::-1])):
            parts.append(f"SELECT * FROM ({_trace_sql(_source('documents', 'doc_id'), wanted, K, _match_sql('doc_id', strand, f"'{name}' AS pattern_id, "))})")
    return " UNION ALL ".join(parts)


def _predicate_sql() -> str:
    """Minima before a G, in texts and, of the complement, in reversed texts."""
    before = "substr(t.s, h.i + 1, 1) = 'G'"
    forward = _trace_sql(_source("documents", "doc_id"), PATTERN, K, _match_sql("doc_id", "+"), before)
    back = _trace_sql(f"SELECT doc_id AS id, reverse({_bases_sql('text')}) AS s FROM documents", _COMPLEMENT["p"], K, _match_sql("doc_id", "-", start="n - stop", end="n - i"), before)
    return f"SELECT * FROM ({forward}) UNION ALL SELECT * FROM ({back})"


def _paths_sql() -> str:
    """Where each operation begins; reversed texts of complements are walked from their ends."""
    tail = "regexp_extract(ops, '[XID]*$')"

    def columns(strand: str, start: str, text: str) -> str:
        moved = lambda letter: f"length(replace(left(ops, p), '{letter}', ''))"
        step = f"""'{{"pattern_pos":' || {moved('D')} || ',"text_pos":' || ({text.format(moved('I'))}) || '}}'"""
        path = f"'[' || coalesce(list_aggregate(list_transform(range(length(ops)), lambda p: {step}), 'string_agg', ','), '') || ']'"
        net = f"CAST(length(replace({tail}, 'D', '')) - length(replace({tail}, 'I', '')) AS INT)"
        return f"id AS doc_id, '{strand}' AS strand, CAST({start} AS INT) AS text_start, {path} AS path, {net} AS net_insertions, {_CIGAR.replace('(ops,', '(reverse(ops),')} AS reverse_cigar"

    forward = _trace_sql(_source("documents", "doc_id"), PATTERN, K, columns("+", "i", "i + {}"))
    back = _trace_sql(f"SELECT doc_id AS id, reverse({_bases_sql('text')}) AS s FROM documents", _COMPLEMENT["p"], K, columns("-", "n - stop", "n - i - 1 - {}"))
    return f"SELECT * FROM ({forward}) UNION ALL SELECT * FROM ({back})"


def _sam_sql() -> str:
    """Regions of forward texts; of reverse complements CIGARs from the region's start on."""
    columns = lambda strand, start, end, region, cigar: f"'p' AS pat_id, id AS text_id, CAST(cost AS INT) AS cost, '{strand}' AS strand, CAST({start} AS INT) AS \"start\", CAST({end} AS INT) AS \"end\", {region} AS match_region, {cigar} AS cigar"
    region = "substr(s, i + 1, stop - i)"
    forward = _trace_sql(_source("benchmark", "item_id"), PATTERN, K, columns("+", "i", "stop", region, _CIGAR))
    back = _trace_sql(f"SELECT item_id AS id, reverse({_bases_sql('text')}) AS s FROM benchmark", _COMPLEMENT["p"], K, columns("-", "n - stop", "n - i", f"reverse({region})", _CIGAR.replace("(ops,", "(reverse(ops),")))
    return f"SELECT * FROM ({forward}) UNION ALL SELECT * FROM ({back})"


def _pretty_sql(context: int = 20) -> str:
    """Lines of matches; what a pattern alone has stands where it would be in the text."""

    def columns(strand: str, pattern: str, middle: str, start: str, end: str, text: str) -> str:
        moved = lambda letter: f"length(replace(left(ops, p), '{letter}', ''))"
        step = f"CASE WHEN substr(ops, p + 1, 1) = 'I' THEN substr('{pattern}', {moved('D')} + 1, 1) ELSE substr(s, i + {moved('I')} + 1, 1) END"
        drawn = middle.format(f"list_aggregate(list_transform(range(length(ops)), lambda p: {step}), 'string_agg', '')")
        before = f"substr({text}, greatest({start} - {context}, 0) + 1, {start} - greatest({start} - {context}, 0))"
        room = f"greatest({context} - (length(ops) - {len(pattern)}), 0)"
        after = f"substr({text}, {end} + 1, {room})"
        skipped = lambda n, form: f"CASE WHEN {n} > 0 THEN {form} ELSE repeat(' ', 15) END"
        number = lambda n: f"lpad(CAST({n} AS VARCHAR), 9, ' ')"
        left, right = f"{start} - length({before})", f"n - {end} - length({after})"
        line = f"""'p ({strand}) ' || lpad(CAST(cost AS VARCHAR), 2, ' ') || ' | ' || {skipped(left, f"{number(left)} || ' bp + '")} || lpad({before}, {context}, ' ') || {drawn} || rpad({after}, CAST({room} AS INT), ' ')
  || {skipped(right, f"' + ' || {number(right)} || ' bp'")} || ' @ ' || rpad(CAST({start} AS VARCHAR) || '-' || CAST({end} AS VARCHAR), 19, ' ')"""
        return f"id AS item_id, '{strand}' AS strand, CAST({start} AS INT) AS text_start, {line} AS pretty"

    forward = _trace_sql(_source("benchmark", "item_id"), PATTERN, K, columns("+", PATTERN, "{}", "i", "stop", "s"))
    back = _trace_sql(f"SELECT item_id AS id, reverse({_bases_sql('text')}) AS s FROM benchmark", _COMPLEMENT["p"], K, columns("-", _COMPLEMENT["p"], "reverse({})", "(n - stop)", "(n - i)", "reverse(s)"))
    return f"SELECT * FROM ({forward}) UNION ALL SELECT * FROM ({back})"


def _all_vs_all_sql() -> str:
    letters = _bases_sql("translate(n_name, '0123456789_', 'bdfhjlnprtv')")
    return f"""WITH names AS (SELECT n_name AS name, {letters} AS s FROM nation),
c_t AS (SELECT p.name AS one, t.name AS two, p.name || ' ' || t.name AS id, p.s AS p, t.s AS s, length(t.s) AS n FROM names p JOIN names t ON p.name <> t.name AND length(p.s) > 0 AND length(t.s) > 0),
c_e AS (SELECT *, unnest(range(0, n + 1)) AS i FROM c_t),
c_w AS (SELECT *, substr(s, greatest(i - length(p) - 2, 0) + 1, least(i, length(p) + 2)) AS w FROM c_e),
c AS (SELECT id, n, i, list_min(list_transform(range(0, length(w) + 1), lambda q: levenshtein(p, right(w, q)))) AS cost FROM c_w), {_minima('c', 2)}
SELECT one AS id, two AS other_id, count(*) AS matches FROM c_hit JOIN c_t USING (id) GROUP BY ALL"""


_TRACE_COLUMNS = f"id AS item_id, CAST(i AS INT) AS text_start, CAST(stop AS INT) AS text_end, CAST(cost AS INT) AS cost, {_CIGAR} AS cigar, substr(s, i + 1, stop - i) AS match_region"

ORACLE_SQL: dict[str, str] = {
    "search_minima": f"{_DOCUMENTS} SELECT id AS doc_id, {_END} FROM c_hit",
    "search_all_ends": f"{_URLS} SELECT id AS page_id, {_END} FROM c WHERE cost <= 2",
    "search_trace": _trace_sql(_source("benchmark", "item_id"), PATTERN, 3, _TRACE_COLUMNS),
    "search_encoded": _encoded_sql(),
    "sam_table": _sam_sql(),
    "pretty_lines": _pretty_sql(),
    "alignment_paths": _paths_sql(),
    "all_vs_all": _all_vs_all_sql(),
    "end_predicate": _predicate_sql(),
    "search_many": " UNION ALL ".join(_part_sql),
    "search_ignore_case": f"WITH {_costs('SELECT page_id AS id, lower(url) AS s FROM pages', 'example.com', 2)}, {_minima('c', 2)} SELECT id AS page_id, {_END} FROM c_hit",
    "best_match": f"""WITH {_costs(_source('benchmark', 'item_id'), BARCODE, BARCODE_K)}, {_minima('c', BARCODE_K)}
SELECT id AS item_id, {_END} FROM c_hit QUALIFY row_number() OVER (PARTITION BY id ORDER BY cost, i DESC) = 1""",
    "cost_histogram": f"WITH {_costs(_CONVERSATIONS, PATTERN, K)}, {_minima('c', K)} SELECT CAST(r.k AS INT) AS cost, count(h.id) AS matches FROM (SELECT unnest(range(0, {K + 1})) AS k) r LEFT JOIN c_hit h ON h.cost = r.k GROUP BY r.k",
    "filter_matching": f"WITH {_costs(_source('documents', 'doc_id'), PATTERN, 1)} SELECT DISTINCT id AS doc_id FROM c WHERE cost <= 1",
    "filter_unmatched": f"WITH {_costs(_source('documents', 'doc_id'), PATTERN, 1)} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM c WHERE cost <= 1)",
    "search_ranges": f"""{_URLS}, g AS (SELECT *, i - row_number() OVER (PARTITION BY id ORDER BY i) AS run FROM c WHERE cost <= 3)
SELECT id AS page_id, CAST(min(i) AS INT) AS first_end, CAST(max(i) AS INT) AS last_end, CAST(min(cost) AS INT) AS cost FROM g GROUP BY id, run""",
    "search_rc": f"""WITH {_costs(f"SELECT row_number() OVER () AS id, s FROM (SELECT {_bases_sql('text')} AS s FROM conversations)", PATTERN, K)}, {_minima('c', K)},
{_costs(f"SELECT row_number() OVER () AS id, reverse(s) AS s FROM (SELECT {_bases_sql('text')} AS s FROM conversations)", _COMPLEMENT['p'], K, 'r')}, {_minima('r', K)},
k AS (SELECT conv_id, row_number() OVER () AS id FROM conversations)
SELECT conv_id, strand, CAST(place AS INT) AS place, CAST(cost AS INT) AS cost, count(*) AS n
FROM (SELECT id, '+' AS strand, i AS place, cost FROM c_hit UNION ALL SELECT id, '-', n - i, cost FROM r_hit) JOIN k USING (id) GROUP BY ALL""",
    "crispr_off_targets": f"""WITH {_costs(_source('benchmark', 'item_id'), GUIDE, GUIDE_K)},
{_costs(f"SELECT item_id AS id, reverse({_bases_sql('text')}) AS s FROM benchmark", _COMPLEMENT['g'], GUIDE_K, 'r')},
f AS (SELECT c.id, '+' AS strand, c.i AS place, c.cost FROM c JOIN c_w w USING (id, i) WHERE c.cost <= {GUIDE_K} AND right(w.w, 3) = '{GUIDE[-3:]}'
  UNION ALL SELECT r.id, '-', r.n - r.i, r.cost FROM r JOIN r_w w USING (id, i) WHERE r.cost <= {GUIDE_K} AND right(w.w, 3) = '{_COMPLEMENT['g'][-3:]}')
SELECT id AS item_id, strand, CAST(place AS INT) AS place, CAST(cost AS INT) AS cost, count(*) AS n FROM f GROUP BY ALL""",
    "sequence_functions": f"""WITH t AS (SELECT doc_id, {_bases_sql('text', WITH_N)} AS s FROM documents)
SELECT doc_id, md5(translate(s, 'ACGTRYKMBDHV', 'TGCAYRMKVHDB')) AS complement_md5, md5(reverse(translate(s, 'ACGTRYKMBDHV', 'TGCAYRMKVHDB'))) AS revcomp_md5,
  regexp_full_match(s, '[ACGTacgt]*') AS valid_dna, true AS valid_iupac, CAST(length(s) - length(replace(s, 'N', '')) AS INT) AS n_count,
  length(s) >= 3 AND regexp_full_match(right(s, 2), '[GN][GN]') AS ends_in_pam FROM t""",
    "window_minima": f"""WITH c AS (SELECT user_id AS id, event_id AS i, CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 7 AS INT) AS cost, 0 AS n FROM events), {_minima('c', 3)}
SELECT id AS user_id, i AS "end", cost FROM c_hit""",
    "window_islands": """WITH c AS (SELECT l_suppkey, l_orderkey % 1000 AS e, CAST(count(*) % 4 AS INT) AS cost FROM lineitem GROUP BY ALL),
g AS (SELECT *, e - row_number() OVER (PARTITION BY l_suppkey ORDER BY e) AS run FROM c WHERE cost <= 1)
SELECT l_suppkey, min(e) AS first_end, max(e) AS last_end, min(cost) AS cost FROM g GROUP BY l_suppkey, run""",
}
