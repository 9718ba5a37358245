"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: one record a page. Of pages with one payload of at least ``REVISIT_FROM``
bytes the one with the smallest id is a response, the others revisit it. Spark's
text writer ends each row with the four bytes that end a WARC record, so part files
are WARC files, gzipped whole, and its commit protocol covers lost tasks.

Reading: tasks scan blocks of an archive for the version line and emit a candidate
(file, offset, successor offset) wherever a header follows. Payloads may hold the
same magic, so candidates are only believed if the chain from the file's start
reaches them: pointer jumping doubles the reach each round.

Ids of any simple type are written as percent-encoded text and come back in their type;
of equal payloads the smallest id, in the order of that type, is the response.

A damaged archive gives the records that the chain reaches; ``damage`` lists the files
whose chain does not come to their end. round_trip reads what it wrote itself, so
damage is an error there.

Defined results: a null html is the empty payload, a response; a null id has a name of
its own and is read as null, and comes after all other ids when a response is chosen;
a null url is left out, a url of any length with line breaks has them escaped; repeated
rows that hold the smallest id are responses each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, text_of

REVISIT_FROM = 100
VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"
BLOCK = 4 << 20
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*\r$", re.M)
NAMED = re.compile(rb"<urn:page:([^>]*)>")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """record: the text of one WARC record a page, without the bytes that end it."""
    html = text_of(F.col(html_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("bytes"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    large = F.col("bytes") >= REVISIT_FROM
    # only payloads that occur again need a join: what moves is a digest and an id for each group
    again = rows.select("page_id", "digest", "bytes").where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    again = again.where("n > 1").select("digest", "first", F.lit(True).alias("copied"))
    marked = rows.join(again, "digest", "left")
    is_copy = large & F.coalesce("copied", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return _record_text(marked.withColumn("copy", is_copy), date)


def _record_text(rows: DataFrame, date: str) -> DataFrame:
    name = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(F.col(c).cast("string")), F.lit(">")), F.lit("<urn:nil>"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n"))
    block = F.when(F.col("copy"), http).otherwise(F.concat(http, F.col("html")))
    url = F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), F.lit("\r\n"))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("copy"), "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name("page_id"), F.lit("\r\nWARC-Date: " + date + "\r\n"), url,
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"),
        F.when(F.col("copy"), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("first"), F.lit("\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
    )
    return rows.select(F.concat(head, F.octet_length(block), F.lit("\r\n\r\n"), block).alias("record"))


def write(pages: DataFrame, path: str, per_file: int = 1000, compression: str = "gzip", **names) -> None:
    """WARC files of at most ``per_file`` records under path."""
    records(pages, **names).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path, compression=compression)


class Headers:
    """Would-be headers of an archive, asked for at rising offsets.

    Version lines before one and the same blank line share the lines after the last of
    them, so those are parsed once: the work is linear in the archive, whatever it holds.
    """

    def __init__(self, data: bytes):
        self.data = data
        self.stop = -2  # the blank line after the offset asked for last; -1: there is none
        self.fields: dict[bytes, tuple[int, bytes]] = {}  # name: where it stands last, value

    def at(self, start: int) -> tuple[int, dict, int, int] | None:
        """(successor, fields, start and end of the block), or None if no header stands there."""
        if self.stop != -1 and start > self.stop:
            self.stop = self.data.find(b"\r\n\r\n", start)
            self.fields = {m[1].lower(): (m.start(), m[2]) for m in FIELD.finditer(self.data, start, self.stop + 2)} if self.stop >= 0 else {}
        fields = {k: v for k, (p, v) in self.fields.items() if p > start}
        length = fields.get(b"content-length", b"")
        if self.stop < 0 or not length.isdigit() or len(length) > 18 or b"warc-type" not in fields:
            return None
        begin, end = self.stop + 4, self.stop + 4 + int(length)
        return end + 4, fields, begin, end


CANDIDATE = "file string, size long, at long, next long, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, intact boolean"
_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())


def _page(value: bytes) -> str | None:
    m = NAMED.fullmatch(value)
    return unquote_plus(m[1].decode("ascii", "replace")) if m else None


def unpacked(data: bytes) -> bytes:
    """The archive without gzip, whose members may follow one another; up to the damage where it is damaged."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, pos = [], 0
    while data[pos : pos + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            while pos < len(data) and not member.eof:
                part = data[pos : pos + (1 << 16)]
                out.append(member.decompress(part))
                pos += len(part) - len(member.unused_data)
        except zlib.error:
            break
    return b"".join(out)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each version line that a header follows, inside payloads too; and one with no offset for each file."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    names = [x.split(" ")[0] for x in CANDIDATE.split(", ")]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py(), unpacked(batch.column(2)[i].as_py())
                size, headers = len(data), Headers(data)  # offsets are those of the archive unpacked
                yield pack([(name, size, *[None] * (len(names) - 2))])
                for low in range(0, max(1, size), BLOCK):
                    rows = []
                    for m in MAGIC.finditer(data, low, min(size, low + BLOCK + len(VERSION) - 1)):
                        if m.start() >= low + BLOCK or (got := headers.at(m.start())) is None:
                            continue
                        after, fields, start, end = got
                        kind = fields[b"warc-type"].decode("ascii", "replace")
                        stated = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha256:").decode("ascii", "replace")
                        split = data.find(b"\r\n\r\n", start, end)
                        body = split + 4 if split >= 0 else min(end, size)
                        if kind == "revisit":  # the payload is elsewhere: its size is in the HTTP header that stays
                            size_line = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})", data[start:body])
                            n, digest, intact = int(size_line[1]) if size_line else -1, stated, True
                        else:
                            payload = memoryview(data)[body:end]
                            n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                            intact = stated in ("", digest)
                        url = fields.get(b"warc-target-uri")
                        rows.append((name, size, m.start(), after, _page(fields.get(b"warc-record-id", b"")), n, digest, kind, _page(fields.get(b"warc-refers-to", b"")), url.decode("utf-8", "replace") if url else None, intact))
                    yield pack(rows)

    return files.mapInArrow(run, CANDIDATE)


def reachable(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether the chain from offset 0 comes to each candidate; at is sorted. Pointer jumping: log2(n) rounds."""
    n = len(at)
    spot = np.minimum(np.searchsorted(at, after), n - 1)
    jump = np.concatenate([np.where(at[spot] == after, spot, n), [n]])  # n: the end, or nowhere
    mark = np.zeros(n + 1, bool)
    mark[0] = n > 0 and at[0] == 0
    while not (jump == n).all():
        mark[jump[mark]] = True
        jump = jump[jump]
    return mark[:n]


def _chain(found: DataFrame) -> DataFrame:
    """file, at of the candidates that the chain from each file's start reaches; a row with no at says how far it came: size, reached."""

    def follow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = int(rows["size"].iloc[0])
        rows = rows[rows["at"].notna()].sort_values("at")
        at, after = rows["at"].to_numpy(np.int64), rows["next"].to_numpy(np.int64)
        kept = reachable(at, after) & (after <= size)  # a record that the end of the file cuts off is damage
        out = pd.DataFrame({"file": key[0], "at": pd.array([*at[kept], None], "Int64"), "size": size, "reached": 0})
        out["reached"] = int(after[kept].max()) if kept.any() else 0
        return out

    # sixteen bytes and a name a candidate come together by file; a file's size bounds them
    return found.select("file", "size", "at", "next").groupBy("file").applyInPandas(follow, "file string, at long, size long, reached long")


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records that the chains reach, and file, size and reached of the damaged files."""
    scratch = Scratch(spark, "warc-read")
    found = scratch.cut(candidates(spark, path))
    chain = scratch.cut(_chain(found))
    kept = chain.where("at is not null").select("file", "at").hint("merge")  # as many rows as records: never a broadcast
    return found.join(kept, ["file", "at"]), chain.where("at is null and reached <> size").select("file", "size", "reached")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under path that the chain from each file's start reaches."""
    return _read(spark, path)[0]


def damage(spark: SparkSession, path: str) -> DataFrame:
    """file, size (bytes unpacked) and reached of the archives under path whose chain of records breaks off before the end."""
    return _read(spark, path)[1]


def round_trip(pages: DataFrame, id_col: str = "page_id", **names) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = Scratch(spark, "warc").path()
    write(pages, path, id_col=id_col, **names)
    records, damaged = _read(spark, path)
    if (broken := damaged.first()) is not None:
        raise ValueError(f"{broken['file']}: the chain of records breaks off at {broken['reached']} of {broken['size']}")
    id_type = pages.schema[id_col].dataType
    refers = F.when(F.col("record_type") == "revisit", F.col("refers_to")).cast(id_type)
    return records.select(F.col("page_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"))
