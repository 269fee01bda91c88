"""Command line: ``python -m nearspark.cli grep|agrep|search|filter|crispr|test``.

``search`` prints a table of matches, ``filter`` the records with (or without)
a match, ``grep`` shows matches in colour, ``agrep`` searches plain text files.
The path ``-`` (or an empty one) is the standard input, in local mode.
"""

from __future__ import annotations

import argparse
import shutil
import sys
import tempfile
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from nearspark.functions.pretty import pretty
from nearspark.operators.crispr import crispr
from nearspark.operators.records import filter_records, histogram
from nearspark.operators.search import pattern_blocks, search
from nearspark.plans.options import SearchOptions
from nearspark.sources import fastx


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="nearspark", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("grep", "search", "filter"):
        p = commands.add_parser(name)
        given = p.add_mutually_exclusive_group(required=True)
        given.add_argument("-p", "--pattern")
        given.add_argument("-l", "--pattern-file", help="a pattern on each line")
        given.add_argument("-f", "--pattern-fasta")
        p.add_argument("-k", type=int, required=True, help="most edits")
        p.add_argument("-a", "--alphabet", choices=("dna", "iupac"), default="iupac")
        p.add_argument("--overhang", type=float, help="cost of a base beyond a text's end")
        p.add_argument("--no-rc", action="store_true")
        p.add_argument("--max-n-frac", type=float, default=0.2)
        p.add_argument("--v2", action="store_true", help="search reverse complements of patterns in the forward text")
        p.add_argument("-j", "--threads", type=int)
        p.add_argument("--pattern-batch-size", type=int, help="accepted; patterns are searched together")
        p.add_argument("-v", "--invert", action="store_true", help="filter: records without a match")
        p.add_argument("--sam", action="store_true", help="regions and CIGARs in text direction")
        p.add_argument("-C", "--context", type=int, default=20)
        p.add_argument("--search", dest="search_out", metavar="PATH", help="grep: also write the table of matches")
        p.add_argument("--filter", dest="filter_out", metavar="PATH", help="grep: also write the records")
        p.add_argument("-o", "--output", help="write here instead of printing")
        p.add_argument("paths", nargs="+")
    p = commands.add_parser("agrep")
    p.add_argument("pattern")
    p.add_argument("-k", type=int, required=True)
    p.add_argument("-i", "--ignore-case", action="store_true")
    p.add_argument("paths", nargs="+")
    p = commands.add_parser("crispr")
    p.add_argument("-g", "--guide", required=True)
    p.add_argument("-k", type=int, required=True)
    p.add_argument("-o", "--output")
    p.add_argument("--max-n-frac", type=float, required=True)
    p.add_argument("-j", "--threads", type=int)
    p.add_argument("--pam-length", type=int, default=3)
    p.add_argument("--allow-pam-edits", action="store_true")
    p.add_argument("--no-rc", action="store_true")
    p.add_argument("path")
    commands.add_parser("test")
    return top


def _show(table: DataFrame, output: str | None) -> None:
    if output:
        fastx.write_tsv(table, output)
        return
    print("\t".join(table.columns))
    for row in table.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def _patterns(spark: SparkSession, args) -> list[tuple[str, bytes]]:
    if args.pattern is not None:
        given = fastx.inline_pattern(args.pattern)
    elif args.pattern_file:
        given = fastx.read_patterns(spark, args.pattern_file)
    else:
        given = fastx.read_pattern_fasta(spark, args.pattern_fasta)
    return [p for _, block in pattern_blocks(given) for p in block]


def run(spark: SparkSession, argv: Sequence[str]) -> int:
    args = parser().parse_args(argv)
    given = [args.path] if "path" in args else getattr(args, "paths", [])
    if not {"", "-"} & set(given):
        return _run(spark, args)
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("the standard input can be read in local mode only: pass a path that executors can open")
    first = sys.stdin.buffer.read(1)
    with tempfile.NamedTemporaryFile(prefix="stdin-", suffix=".fq" if first == b"@" else ".fa") as file:
        file.write(first)
        shutil.copyfileobj(sys.stdin.buffer, file)
        file.flush()
        args.path = file.name
        args.paths = [file.name if p in ("", "-") else p for p in dict.fromkeys("-" if p == "" else p for p in given)]
        return _run(spark, args)


def _run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "test":
        return _test(spark)
    if args.command == "crispr":
        guides = fastx.read_guides(spark, args.guide)
        found = crispr(fastx.read_fastx(spark, [args.path]), guides, args.k, args.max_n_frac, args.pam_length, args.allow_pam_edits, not args.no_rc)
        _show(fastx.match_table(found, first="guide"), args.output)
        return 0
    if args.command == "agrep":
        options = SearchOptions(alphabet="ascii_ci" if args.ignore_case else "ascii", k=args.k)
        found = search(fastx.read_text(spark, args.paths), [("pattern", args.pattern)], options, text_col="seq")
        lines = pretty(found, {"pattern": args.pattern.encode()}, style="line")
        for row in lines.orderBy("text_id", "text_start").select("text_id", "pretty").toLocalIterator():
            print(f"{row[0]}: {row[1]}")
        return 0
    options = SearchOptions(alphabet=args.alphabet, k=args.k, rc=not args.no_rc, alpha=args.overhang, max_n_frac=args.max_n_frac, rc_mode="pattern" if args.v2 else "text")
    patterns = _patterns(spark, args)
    texts = fastx.read_fastx(spark, args.paths)
    if args.command == "filter":
        _records(filter_records(texts, patterns, options, args.invert, "seq"), args.output)
        return 0
    found = search(texts, patterns, options, text_col="seq")
    if args.command == "search":
        _show(fastx.match_table(found, args.alphabet, args.sam), args.output)
        return 0
    lines = pretty(found, dict(patterns), context=args.context)
    for row in lines.orderBy("path", "text_id", "text_start").select("path", "text_id", "pretty").toLocalIterator():
        print(f"{row[0]}>{row[1]}\n{row[2]}", file=sys.stderr)
    for row in histogram(found, args.k).orderBy("cost").collect():
        print(f"{row[0]:>4}: {row[1]}", file=sys.stderr)
    if args.search_out:
        fastx.write_tsv(fastx.match_table(found, args.alphabet, args.sam), args.search_out)
    if args.filter_out:
        _records(filter_records(texts, patterns, options, args.invert, "seq"), args.filter_out)
    return 0


def _records(records: DataFrame, output: str | None) -> None:
    if output:
        fastx.write_records(records, output)
        return
    for row in records.select(fastx.record_text()).toLocalIterator():
        print(row[0])


def _test(spark: SparkSession) -> int:
    """Versions, and the speed of the kernel over random bases."""
    text = "".join("ACGT"[(i * 7919 + i // 13) % 4] for i in range(100_000))
    texts = spark.range(64).repartition(spark.sparkContext.defaultParallelism).select(F.lit(text).alias("seq"))
    found = search(texts, ["ACGTTGCATTGACCAGTACGATC"], SearchOptions(alphabet="dna", k=1, trace=False), text_col="seq", prefilter=False)
    found.count()
    began = time.time()
    n = found.count()
    print(f"Spark {spark.version}, {spark.sparkContext.defaultParallelism} tasks at once: {6.4 / (time.time() - began):.1f} MB/s, {n} matches")
    return 0


if __name__ == "__main__":
    raise SystemExit(run(SparkSession.builder.appName("nearspark").getOrCreate(), sys.argv[1:]))
