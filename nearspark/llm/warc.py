"""A content-addressed archive of WARC records.

A record is its exact header bytes (WARC and HTTP headers, to the blank line)
and, for responses, a payload.  The archive keeps headers in one table and
every distinct payload once in another, under its SHA-256; records are put
together again by joining the two.  Digests are verified: on writing, payloads
of one SHA-256 must agree in length and SHA-1; on reading, a payload must have
the SHA-256 that it is stored under.

``write_files`` and ``read_files`` turn records into WARC files and back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from nearspark.llm.shared import plain_names

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

DATE = "2000-01-01T00:00:00Z"
RECORD_ID = "urn:page:"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1, without padding (160 bits need none)."""
    digits = F.sha1(data)
    quads = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def make_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = 0, date: str = DATE) -> DataFrame:
    """(page_id, headers, payload, sha256, payload_digest, n_bytes, record_type, refers_to) for each page.

    The payload is the text in UTF-8 or the bytes; null is empty.  Among
    records of equal payloads of at least ``least_revisit`` bytes, those with
    the least id are responses and the others revisits that refer to it;
    shorter ones are all responses.  A null id is never the least unless all
    are null; rows that repeat the least id are all responses.  Line ends in a
    URL or an id are percent-encoded; a null URL or id gives an empty one.
    An empty table gives an empty one; other columns are not read.  A payload
    that a third of all pages share is one key of the join here and of that in
    ``read_archive``; Spark splits such a partition.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha256": F.unhex(F.sha2("payload", 256)), "payload_digest": base32_sha1(F.col("payload")), "n_bytes": F.octet_length("payload").cast("long")})
    groups = rows.groupBy("sha256").agg(F.min("page_id").alias("least"), F.min("n_bytes").alias("n1"), F.max("n_bytes").alias("n2"), F.min("payload_digest").alias("d1"), F.max("payload_digest").alias("d2"))
    verified = (F.col("n1") == F.col("n2")) & (F.col("d1") == F.col("d2"))
    least = F.when(verified, F.col("least")).otherwise(F.raise_error(F.lit("different payloads have one SHA-256")))
    rows = rows.join(groups.select("sha256", least.alias("least")), "sha256")
    revisit = (F.col("n_bytes") >= least_revisit) & ~F.col("page_id").eqNullSafe(F.col("least"))
    rows = rows.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("least"))})
    length = F.lit(len(HTTP)) + F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    plain = lambda c: F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    urn = lambda c: F.concat(F.lit(f"<{RECORD_ID}"), plain(c), F.lit(">"))
    headers = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", plain(F.col("url"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("least"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(f"\r\n{HTTP}"),
    ).cast("binary")
    return rows.select("page_id", headers.alias("headers"), "payload", "sha256", "payload_digest", "n_bytes", "record_type", "refers_to")


def write_archive(records: DataFrame, path: str) -> None:
    """Folders kind=header and kind=payload below ``path``, in one pass over the records.

    A payload is stored by the response that holds it; responses that repeat
    one (rows of equal ids, or short payloads) store it once all the same,
    since ``read_archive`` takes one of equal digests.
    """
    header = F.struct(F.lit("header").alias("kind"), F.col("headers"), F.lit(None).cast("binary").alias("payload"), F.col("sha256"), F.col("n_bytes"))
    payload = F.struct(F.lit("payload").alias("kind"), F.lit(None).cast("binary").alias("headers"), F.col("payload"), F.col("sha256"), F.col("n_bytes"))
    first = F.col("record_type") == "response"
    parts = F.when(first, F.array(header, payload)).otherwise(F.array(header))
    records.select(F.inline(parts)).write.partitionBy("kind").mode("overwrite").parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(record, sha256, payload_bytes): the original records' bytes, and the size of each one's full payload.

    Responses are headers, payload and two line ends; revisits have no payload.
    A payload that does not have the digest or the size it is stored under is
    an error; revisits take the size of the response's verified payload.  An
    archive without records gives no rows.
    """
    schema = "headers binary, payload binary, sha256 binary, n_bytes long, kind string"
    rows = spark.read.schema(schema).parquet(path)
    headers = rows.where("kind = 'header'").select("headers", "sha256")
    is_revisit = F.col("headers").cast("string").startswith(f"{VERSION}\r\nWARC-Type: revisit\r\n")
    stored = rows.where("kind = 'payload'")
    same = (F.unhex(F.sha2("payload", 256)) == F.col("sha256")) & (F.octet_length("payload") == F.col("n_bytes"))
    sound = F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
    payloads = stored.groupBy("sha256").agg(F.first(F.struct("payload", "n_bytes")).alias("one")).select("sha256", "one.*").select("sha256", sound.alias("payload"))
    sizes = stored.groupBy("sha256").agg(F.max("n_bytes").alias("payload_bytes"))
    end = F.lit(b"\r\n\r\n")
    whole = headers.where(~is_revisit).join(payloads, "sha256").select(F.concat("headers", "payload", end).alias("record"), "sha256", F.octet_length("payload").cast("long").alias("payload_bytes"))
    return whole.unionByName(headers.where(is_revisit).join(sizes, "sha256").select(F.concat("headers", end).alias("record"), "sha256", "payload_bytes"))



def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The named fields and the block of the record at ``at``, and where the next one begins."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError(f"no WARC record at byte {at}")
    fields = {}
    for line in lines:
        name, _, value = line.partition(b":")
        fields[name.decode().strip().lower()] = value.decode("utf-8", "replace").strip()
    size = fields.get("content-length", "")
    if not size.isdigit():
        raise ValueError(f"the record at byte {at} has no length")
    begin = stop + 4
    end = begin + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at byte {at} does not end where its length says")
    return fields, data[begin:end], end + 4


def _parsed_fields(ids: T.DataType) -> list[T.StructField]:
    kinds = {"page_id": ids, "record_type": T.StringType(), "target_uri": T.StringType(), "payload_digest": T.StringType(), "refers_to": ids, "payload": T.BinaryType()}
    return [T.StructField(name, kind) for name, kind in kinds.items()]


def _page(value: str | None) -> str | None:
    return (value or "").removeprefix("<").removesuffix(">").removeprefix(RECORD_ID) or None


def _number(value: str | None) -> int | None:
    if value is None or re.fullmatch(r"-?[0-9]{1,18}", value):
        return None if value is None else int(value)
    raise ValueError(f"the record id {value!r} is not an integer; read ids as strings")


def _parsed(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        fields, block, at = parse_record(data, at)
        payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        kind = fields.get("warc-type")
        yield _page(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), digest, _page(fields.get("warc-refers-to")), None if kind == "revisit" else payload


def parse_records(df: DataFrame, column: str = "record", keep: list[str] | None = None, payloads: bool = True, ids: str = "string") -> DataFrame:
    """The parsed records of a column of WARC bytes (one record or many), with the columns ``keep``.

    ``ids`` is the type of page_id and refers_to, "string" or "long"; as "long",
    one that is no integer is an error.  Empty ids are null.  Null and empty
    values hold no records; ``payloads=False`` leaves the payload null.  Kept
    columns named like the results are replaced; an empty table gives an empty
    one.
    """
    of_ids = T.LongType() if ids == "long" else T.StringType()
    made = _parsed_fields(of_ids)
    carried, fields = plain_names(df, keep or [], made)
    schema = T.StructType(fields + made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        typed = pa.int64() if ids == "long" else pa.string()
        kinds = [typed, pa.string(), pa.string(), pa.string(), typed, pa.binary()]
        for batch in batches:
            rows, source, size = [], [], 0
            for i, data in enumerate(batch.column(0).to_pylist()):
                for row in _parsed(data or b""):
                    if ids == "long":
                        row = (_number(row[0]), *row[1:4], _number(row[4]), row[5])
                    rows.append(row if payloads else (*row[:-1], None))
                    source.append(i)
                    size += len(row[-1] or b"") if payloads else 0
                    if size > 16 << 20:
                        yield _batch(batch, rows, source, kinds, schema)
                        rows, source, size = [], [], 0
            yield _batch(batch, rows, source, kinds, schema)

    return df.select(F.col(f"`{column}`").cast("binary").alias("record"), *carried).mapInArrow(run, schema)


def _batch(batch: pa.RecordBatch, rows: list[tuple], source: list[int], kinds: list[pa.DataType], schema: T.StructType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    taken = [c.take(pa.array(source, pa.int64())) for c in batch.columns[1:]]
    return pa.RecordBatch.from_arrays(taken + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)


def write_files(records: DataFrame, path: str, per_file: int = 2000, compression: str = "none") -> None:
    """WARC files of at most ``per_file`` records below ``path``, from (headers, payload, record_type).

    The two line ends that close a record are the separator of Spark's text
    writer, which writes the bytes of a value as they are.
    """
    record = F.when(F.col("record_type") == "revisit", F.col("headers")).otherwise(F.concat("headers", "payload"))
    records.select(record.cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).option("compression", compression).mode("overwrite").text(path)


def read_files(spark: SparkSession, path: str, ids: str = "string") -> DataFrame:
    """The parsed records of all uncompressed WARC files below ``path``; a file is one task's work, in memory."""
    return parse_records(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path), "content", ids=ids)
