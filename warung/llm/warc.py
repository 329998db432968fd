"""WARC archives: a writer on Spark's text sink and a Python data source.

``write_warc`` stores pages as WARC/1.1 records.  Of records with equal
payloads of some size the one of the smallest id is a response, the others are
revisits that refer to it and carry no payload.  Every task writes one archive
(gzip), through Spark's own writer, so any file system Spark knows will do.

``WarcSource`` reads archives back: one partition per file, predicates on the
record type and on header columns pushed down, headers parsed first, and a
payload decoded only when the record is wanted and payloads are asked for.

Defined results: a null payload is empty; a null url is written without a
target and read back as null; a page without an id is written without a record
id and read back with a null one (a revisit, if a page with an id has its
payload); repeated rows are written once each (rows equal in both id and
payload are all responses if theirs is the smallest id).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition,
                                    IsNotNull)

END = "\r\n\r\n"
ID = "urn:warung:page:"
SCHEMA = ("record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
          "payload_bytes long, date string, payload string, payload_sha256 string")
#: header name by column
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
           "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
           "payload_bytes": "x-payload-length", "date": "warc-date"}


# ------------------------------------------------------------------ writing
def with_revisits(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """Adds ``payload``, ``payload_bytes``, ``payload_digest`` (hex SHA-256),
    ``refers_to`` (null for responses).  Only the digest table is grouped, with
    map-side combining; pages meet it in a join that can be split when a third
    of all pages are one payload."""
    rows = (pages.withColumn("payload", F.coalesce(F.col(html_col), F.lit("")))
            .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
            .withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256)))
    # payloads below the limit are groups of their own
    rows = rows.withColumn("_group", F.when(F.col("payload_bytes") >= least_bytes, F.col("payload_digest"))
                           .otherwise(F.concat_ws("#", F.lit("small"), F.col(id_col).cast("string"), F.xxhash64("payload_digest").cast("string"))))
    first = rows.groupBy("_group").agg(F.min(id_col).alias("_first"))
    met = rows.join(first, "_group", "left")
    return (met.withColumn("refers_to", F.when(~F.col(id_col).eqNullSafe(F.col("_first")), F.col("_first")))
            .drop("_group", "_first"))


def record(id_col: str, url_col: str, date: str) -> Column:
    """The text of one record without its closing blank lines."""
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    uri = F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7f]", "%20")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.when(F.col(id_col).isNull(), "").otherwise(line("WARC-Record-ID", F.concat(F.lit(f"<{ID}"), F.col(id_col).cast("string"), F.lit(">")))),
        line("WARC-Date", F.lit(date)),
        F.when(uri.isNull(), "").otherwise(line("WARC-Target-URI", uri)),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", F.concat(F.lit(f"<{ID}"), F.col("refers_to").cast("string"), F.lit(">"))),
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.lit("Content-Type: text/html\r\n"),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(END), body)


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one gzip archive per task under ``path``."""
    rows = with_revisits(pages.select(id_col, url_col, html_col), id_col=id_col, html_col=html_col, least_bytes=least_bytes)
    (rows.select(record(id_col, url_col, date).alias("value")).write
     .option("lineSep", END).option("compression", "gzip").text(path))


def archive_files(spark: SparkSession, path: str) -> list[str]:
    """The archives under ``path``, listed by Spark."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length")
    return [r["path"] for r in found.where("length > 0").orderBy("path").collect()]


# ------------------------------------------------------------------ reading
@dataclass
class WarcFile(InputPartition):
    path: str


class _Stream:
    """Exact reads from a gzip or plain archive, in bounded memory."""

    def __init__(self, raw, room: int = 1 << 18):
        self.raw, self.room, self.have = raw, room, b""
        head = raw.read(2)
        self.plain = head != b"\x1f\x8b"
        self.unzip, self.pending = zlib.decompressobj(31), head
        self.ended = False

    def _more(self) -> bool:
        chunk = self.pending or self.raw.read(self.room)
        self.pending = b""
        if not chunk:
            self.ended = True
            return False
        if self.plain:
            self.have += chunk
            return True
        self.have += self.unzip.decompress(chunk)
        if self.unzip.eof:                          # the next member, one per record in many archives
            self.pending, self.unzip = self.unzip.unused_data, zlib.decompressobj(31)
        return True

    def head(self) -> bytes | None:
        """The next header block, or None at the end."""
        while True:
            self.have = self.have.lstrip(b"\r\n") if self.have[:1] in (b"\r", b"\n") else self.have
            at = self.have.find(b"\r\n\r\n")
            if at >= 0:
                block, self.have = self.have[:at], self.have[at + 4:]
                return block
            if not self._more():
                if self.have.strip():
                    raise ValueError("archive ends inside a header")
                return None

    def body(self, n: int, keep: bool) -> bytes:
        """The next ``n`` bytes; without ``keep`` they are passed over piecewise."""
        kept, left = [], n
        while left:
            if not self.have and not self._more():
                raise ValueError("archive ends inside a payload")
            piece, self.have = self.have[:left], self.have[left:]
            left -= len(piece)
            if keep:
                kept.append(piece)
        return b"".join(kept)


def parse_headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = (x.partition(":") for x in lines[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _columns(head: dict[str, str]) -> dict:
    out = {c: head.get(h) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        out[c] = out[c].strip("<>") if out[c] else None
    out["payload_digest"] = (out["payload_digest"] or "").removeprefix("sha256:") or None
    n = out["payload_bytes"]
    out["payload_bytes"] = int(n if n is not None else head.get("content-length", 0))
    return out


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = [f for f in options["files"].split("\n") if f]
        self.payloads = str(options.get("payloads", "true")).lower() == "true"
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, membership and presence on header columns."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, EqualNullSafe)):
                self.wanted.append((column, (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.wanted.append((column, tuple(f.value)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.wanted.append((column, ()))
            else:
                yield f

    def partitions(self) -> list[WarcFile]:
        return [WarcFile(f) for f in self.files]

    def _fits(self, row: dict) -> bool:
        return all(row[c] in values if values else row[c] is not None for c, values in self.wanted)

    def read(self, partition: WarcFile) -> Iterator[tuple]:
        from pyarrow import fs
        store, path = fs.FileSystem.from_uri(partition.path)
        with store.open_input_stream(path, compression=None, buffer_size=1 << 18) as raw:
            stream = _Stream(raw)
            while (block := stream.head()) is not None:
                head = parse_headers(block)
                row = _columns(head)
                fits = self._fits(row)
                body = stream.body(int(head.get("content-length", 0)), fits and self.payloads)
                if fits:
                    text = body.decode("utf-8", "replace") if self.payloads else None
                    digest = hashlib.sha256(body).hexdigest() if self.payloads else None
                    yield (*(row[c] for c in HEADERS), text, digest)


class WarcSource(DataSource):
    """``spark.read.format("warung_warc").option("files", "path\\npath")``; with
    ``payloads=false`` no payload is decoded."""

    @classmethod
    def name(cls) -> str:
        return "warung_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """All records of the archives under ``path``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    files = archive_files(spark, path)
    if not files:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format("warung_warc").option("files", "\n".join(files)).option("payloads", str(payloads).lower()).load()
