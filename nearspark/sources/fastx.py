"""FASTA, FASTQ, pattern and guide files; match tables and records as files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nearspark.functions.columns import format_cigar, match_region

RECORD = T.StructType([T.StructField("text_id", T.StringType()), T.StructField("seq", T.StringType()), T.StructField("quality", T.StringType()), T.StructField("path", T.StringType())])
#: The columns of a table of matches.
TSV = ("pat_id", "text_id", "cost", "strand", "start", "end", "match_region", "cigar")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(text_id, seq, quality, path) of FASTA files; quality is null.

    text_id is the whole header line.  Files may be compressed as Hadoop's
    codecs allow; uncompressed ones are split between tasks.  Blank records
    are left out, line ends may be of either kind.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("value"), F.col("_metadata.file_path").alias("path"))
    record = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    parts = F.split(record, "\n", 2)
    seq = F.translate(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), "\n", "")
    return rows.where(F.length(F.trim("value")) > 0).select(parts[0].alias("text_id"), seq.alias("seq"), F.lit(None).cast("string").alias("quality"), "path")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(text_id, seq, quality, path) of FASTQ files of four-line records.

    Files may be compressed as Hadoop's codecs allow; uncompressed ones are
    split between tasks.  A record whose quality begins with @ and lies on the
    edge of two splits is put together from both, which takes a second look at
    those files.  Line ends may be of either kind; a file of another form is an
    error.
    """

    def pieces(names: str) -> DataFrame:
        rows = spark.read.option("lineSep", "\n@").option("pathGlobFilter", names).text(path)
        placed = rows.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"))
        return placed.mapInArrow(_fastq, _PIECE)

    whole = pieces("*").where(F.col("part") == _WHOLE).select(*RECORD.names)
    order = Window.partitionBy("path").orderBy("split", F.desc("part"))
    torn = pieces("*[!z]").where(F.col("part") != _WHOLE).withColumn("before", F.lag("part").over(order)).withColumn("after", F.lead("part").over(order)).withColumn("rest", F.lead("quality").over(order))
    fits = F.when(F.col("part") == _HEAD, F.col("after").eqNullSafe(_TAIL)).otherwise(F.col("before").eqNullSafe(_HEAD))
    quality = F.when(fits, F.col("rest")).otherwise(F.raise_error(F.concat("path", F.lit(_NO_FASTQ))))
    mended = torn.where((F.col("part") == _HEAD) | ~fits).select("text_id", "seq", quality.alias("quality"), "path")
    return whole.unionByName(mended)


_WHOLE, _HEAD, _TAIL = 0, 1, 2
_PIECE = T.StructType([*RECORD, T.StructField("split", T.LongType()), T.StructField("part", T.IntegerType())])
_NO_FASTQ = " is no FASTQ file of four-line records"


def _fastq(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of what lies between line ends that @ follows, in the order of a split.

    A record with a quality that begins with @ is two pieces: three lines and
    one.  Where a split ends between them its part is marked.
    """
    here, head, fresh = None, None, True
    out = to_arrow_schema(_PIECE)
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

    for batch in batches:
        rows = []
        for value, *place in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            path, split = place
            if place != here:
                if head is not None:
                    rows.append((*head, None, *here, _HEAD))
                here, head, fresh = place, None, True
            lines = [x.rstrip("\r") for x in value.split("\n")]
            opens = fresh and split == 0
            if opens and not any(lines):
                continue
            if opens and not lines[0].startswith("@"):
                raise ValueError(path + _NO_FASTQ)
            while len(lines) > 4 and not lines[-1]:
                lines.pop()
            name = lines[0][1:] if opens else lines[0]
            if head is None and len(lines) in (3, 4) and lines[2].startswith("+"):
                if len(lines) == 4 and lines[1] and not lines[3]:
                    raise ValueError(path + _NO_FASTQ)
                if len(lines) == 4:
                    rows.append((name, lines[1], lines[3], path, split, _WHOLE))
                else:
                    head = (name, lines[1])
            elif any(lines[1:]) or (head is None and (opens or not fresh or split == 0)):
                raise ValueError(path + _NO_FASTQ)
            elif head is None:
                rows.append((None, None, "@" + lines[0], path, split, _TAIL))
            else:
                rows.append((*head, "@" + lines[0], path, split, _WHOLE))
                head = None
            fresh = False
        yield made()
    if head is not None:
        rows = [(*head, None, *here, _HEAD)]
        yield made()


def read_fastx(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of files of either kind, told by their names (.fq, .fastq, with or without .gz)."""
    fastq = [p for p in paths if p.removesuffix(".gz").endswith((".fq", ".fastq"))]
    fasta = [p for p in paths if p not in fastq]
    parts = ([read_fasta(spark, fasta)] if fasta else []) + ([read_fastq(spark, fastq)] if fastq else [])
    if not parts:
        raise ValueError("there are no paths")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(text_id, seq) of whole files; seq is binary."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("text_id"), F.col("content").alias("seq"))


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """The lines of one small file."""
    whole = spark.read.text(path, wholetext=True).first()
    return [] if whole is None else whole[0].replace("\r\n", "\n").removesuffix("\n").split("\n")


def read_patterns(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """One pattern a line; its id is the number of the line.  Blank lines are left out."""
    return [(str(i), line) for i, line in enumerate(read_lines(spark, path), 1) if line]


def read_pattern_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(pattern_id, pattern) of a FASTA file."""
    return read_fasta(spark, path).select(F.col("text_id").alias("pattern_id"), F.col("seq").alias("pattern"))


def inline_pattern(pattern: str) -> list[tuple[str, str]]:
    return [("pattern", pattern)]


def read_guides(spark: SparkSession, path: str) -> list[str]:
    """One guide a line; blank lines are left out."""
    return [line for line in read_lines(spark, path) if line]


def match_table(matches: DataFrame, letters: str = "iupac", sam: bool = False, text_id: str = "text_id", seq: str = "seq", first: str = "pat_id") -> DataFrame:
    """The columns of a match table, of traced matches with their text's id and (ASCII) sequence."""
    region = match_region(F.col(seq).cast("string"), letters=letters, sam=sam) if letters in ("dna", "iupac") else F.col(seq).cast("string").substr(F.col("text_start") + 1, F.col("text_end") - F.col("text_start"))
    return matches.select(F.col("pattern_id").alias(first), F.col(text_id).alias("text_id"), "cost", "strand", F.col("text_start").alias("start"), F.col("text_end").alias("end"), region.alias("match_region"), format_cigar(sam=sam).alias("cigar"))


def write_tsv(table: DataFrame, path: str) -> None:
    """A table as tab-separated files with a header line each."""
    table.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").mode("overwrite").csv(path)


def record_text(text_id: str = "text_id", seq: str = "seq", quality: str = "quality") -> Column:
    """A record as FASTQ if it has a quality, else as FASTA."""
    fastq = F.concat(F.lit("@"), F.col(text_id), F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.col(quality))
    return F.when(F.length(quality) > 0, fastq).otherwise(F.concat(F.lit(">"), F.col(text_id), F.lit("\n"), F.col(seq)))


def write_records(records: DataFrame, path: str) -> None:
    records.select(record_text().alias("value")).write.mode("overwrite").text(path)
