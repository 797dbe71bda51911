"""Legacy ARC archives converted to WARC, and WARC archives read back.

An ARC file begins with a version block, which says how the header line of every record
is laid out (version 1 or 2); a record is that line, as many bytes as it declares, and a
newline. Each becomes a WARC record with an identifier made from its content (so a task
that runs again makes the same one), an ISO timestamp, a type and SHA-1 digests.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes one is kept as a
response and the others become revisits of it, without the payload. Which one is found by
an aggregation over digests; payloads are shuffled once and only meet the few digests that
occur twice.

A WARC file is its records one after another, so Spark's own text writer writes them, to
any file system it knows; reading back takes whole files, in pieces that the writer bounds.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairrank.llm.expressions import pick
from pairrank.runtime import checkpoint_folder

REVISIT_BYTES = 1000
# Records of one file; what one file holds is read back by one task.
RECORDS_PER_FILE = 20_000
# Bytes of one ARC archive, beyond which the next is begun.
ARCHIVE_BYTES = 4 << 20

# The header lines that the two ARC versions declare, and the WARC profile of a revisit.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URL = "unknown:"
RECORD = (
    "record_id string, date string, url string, ip string, http binary, payload binary, key long, status int, mime string"
)


# --- ARC ------------------------------------------------------------------------


def arc_header(version: int, values: dict[str, str]) -> bytes:
    return (" ".join(values.get(f, "-") for f in ARC_FIELDS[version].split()) + "\n").encode()


def write_arc(name: str, version: int, date: str, records: Iterator[tuple[str, bytes]]) -> bytes:
    """An archive of (URL, HTTP response) records."""
    body = f"{version} 0 pairrank\n{ARC_FIELDS[version]}\n\n".encode()
    first = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain",
             "Result-code": "200", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    out = io.BytesIO()
    out.write(arc_header(version, first) + body + b"\n")
    for url, response in records:
        out.write(arc_header(version, first | {
            "URL": url, "IP-address": "127.0.0.1", "Content-type": "text/html", "Offset": str(out.tell()),
            "Archive-length": str(len(response))}) + response + b"\n")
    return out.getvalue()


def read_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of every record of an archive, plain or gzipped, after its version block.

    A header is split from the right, so a URL may hold spaces. An archive that does not
    begin with a version block, or ends within a record, raises ValueError.
    """
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at, fields = 0, None
    while at < len(content):
        if content[at] in b"\r\n":
            at += 1
            continue
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line is cut off")
        line = content[at:end].decode("utf-8", "replace").rstrip("\r")
        length = line.rpartition(" ")[2]
        if not length.isdigit():
            raise ValueError(f"no length in the ARC header {line[:200]!r}")
        body = content[end + 1 : end + 1 + int(length)]
        if len(body) < int(length):
            raise ValueError(f"the ARC record {line[:200]!r} is cut off")
        at = end + 1 + int(length)
        if fields is None:
            first = body.split(b"\n", 1)[0].split()
            if not line.startswith("filedesc:") or not first or not first[0].isdigit() or int(first[0]) not in ARC_FIELDS:
                raise ValueError("not an ARC archive of version 1 or 2")
            fields = ARC_FIELDS[int(first[0])].split()
            continue
        values = line.rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"the ARC header {line[:200]!r} lacks fields")
        yield dict(zip(fields, values)), body


def split_response(response: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with the blank line) and payload; a body without an HTTP head is all payload."""
    if not response.startswith(b"HTTP/"):
        return b"", response
    head, blank, payload = response.partition(b"\r\n\r\n")
    return (head + blank, payload) if blank else (response, b"")


def http_field(head: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head, re.I | re.M)
    return found[1].strip() if found else None


def convert_record(fields: dict[str, str], response: bytes) -> tuple:
    """The WARC counterpart of one ARC record, without its type, as a row of ``RECORD``."""
    head, payload = split_response(response)
    d = fields["Archive-date"].ljust(14, "0")
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    named = hashlib.sha1(f"{fields['URL']} {date} ".encode() + head + hashlib.sha1(payload).digest())
    status = re.match(rb"HTTP/\S+ (\d{3})", head)
    key = http_field(head, b"X-Page-Id")
    return (f"urn:uuid:{uuid.UUID(bytes=named.digest()[:16], version=5)}", date, fields["URL"], fields["IP-address"], head, payload,
            int(key) if key else None, int(status[1]) if status else None, fields["Content-type"])


def archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Legacy archives of web pages: path and content, versions 1 and 2 in turn.

    The payload is ``html`` in UTF-8, empty if null; the page's id travels in the HTTP head.
    White space in a URL is percent-encoded; a missing one is written as ``unknown:``.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = 0
        for batch in batches:
            waiting, size = [], 0
            for i, row in enumerate(zip(batch["page_id"], batch["url"], batch["html"])):
                key, address, page = row
                payload = b"" if page is None else page.encode("utf-8", "surrogatepass")
                address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", address or "") or NO_URL
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                head += "" if pd.isna(key) else f"X-Page-Id: {int(key)}\r\n"
                waiting.append((address, head.encode() + b"\r\n" + payload))
                size += len(payload)
                if size >= ARCHIVE_BYTES or i == len(batch) - 1:
                    name = f"{hashlib.sha1(repr(waiting[0]).encode()).hexdigest()}.arc"
                    yield pd.DataFrame({"path": [name], "content": [write_arc(name, 1 + count % 2, "20260101000000", iter(waiting))]})
                    waiting, size, count = [], 0, count + 1

    rows = pick(pages, page_id=page_id, url=url, html=html)
    # As text, so that a null id does not turn ids into floating point numbers.
    return rows.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(encode, "path string, content binary")


def convert(arcs: DataFrame) -> DataFrame:
    """Records of ARC archives (path and content, as ``spark.read.format("binaryFile")`` gives them).

    ``digest`` is the bare SHA-1 of the payload. An archive that cannot be parsed fails the
    job and names the archive.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [convert_record(*r) for r in read_arc(content)]
                except ValueError as error:
                    raise ValueError(f"{path}: {error}") from error
                yield pd.DataFrame(rows, columns=names).astype({"key": "Int64", "status": "Int32"})

    return pick(arcs, path="path", content="content").mapInPandas(parse, RECORD).withColumn("digest", F.sha1("payload"))


# --- WARC -----------------------------------------------------------------------


def deduplicated(records: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``records`` with type and refers_to (the record id of the response that a revisit repeats).

    Of equal payloads of at least ``least`` bytes the records with the largest key are
    responses (null is the smallest; rows that repeat that key all are), the others
    revisits. Smaller payloads are responses.
    """
    large = records.where(F.octet_length("payload") >= least)
    repeated = (
        large.groupBy(F.col("digest").alias("same")).agg(F.count("*").alias("n"), F.max(F.struct("key", "record_id")).alias("top"))
        .where("n > 1").select("same", "top")
    )
    joined = records.join(repeated, (F.col("digest") == F.col("same")) & (F.octet_length("payload") >= least), "left")
    revisit = F.col("same").isNotNull() & ~F.col("key").eqNullSafe(F.col("top.key"))
    return joined.select(
        *records.columns, F.when(revisit, "revisit").otherwise("response").alias("type"),
        F.when(revisit, F.col("top.record_id")).alias("refers_to"))


def warc_record(record: dict[str, Column] | None = None) -> Column:
    """A whole WARC record as text, but for the newline that the text writer adds."""
    block = F.when(F.col("type") == "response", F.concat("http", "payload")).otherwise(F.col("http"))
    kind = F.when(F.length("http") > 0, F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    revisit = F.col("type") == "revisit"
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("type")), line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("url")), line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(block))),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<"), "refers_to", F.lit(">")))).otherwise(""),
        line("Content-Type", kind), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    return F.concat(head, block.cast("string"), F.lit("\r\n\r"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write typed records as gzipped WARC files below ``path``."""
    text = records.select(warc_record().alias("value"))
    text.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record of a WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:100]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("a WARC record is cut off")
        yield fields, block


def described(fields: dict[str, str], block: bytes) -> tuple:
    """A row of what ``read_warc`` returns, with the digests checked."""
    head, payload = split_response(block) if fields.get("content-type", "").startswith("application/http") else (b"", block)
    digest, response = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "response"
    if "sha1:" + hashlib.sha1(block).hexdigest() != fields["warc-block-digest"] or response and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"{fields['warc-record-id']}: the digest is another")
    key, declared = http_field(head, b"X-Page-Id"), http_field(head, b"Content-Length")
    size = len(payload) if response else int(declared) if declared else None
    return (fields["warc-record-id"].strip("<>"), fields["warc-date"], fields["warc-target-uri"], fields["warc-type"],
            fields.get("warc-refers-to", "").strip("<>") or None, digest, size, int(key) if key else None, payload if response else None)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files below ``path``, plain or gzipped; every digest is checked.

    payload is null for a revisit; payload_bytes is then what its HTTP head declares.
    """
    names = ["record_id", "date", "url", "type", "refers_to", "digest", "payload_bytes", "key", "payload"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                raw = io.BytesIO(content)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if content[:2] == b"\x1f\x8b" else raw
                rows, size = [], 0
                for fields, block in read_records(stream):
                    rows.append(described(fields, block))
                    size += len(block)
                    if size >= ARCHIVE_BYTES:
                        yield pd.DataFrame(rows, columns=names).astype({"key": "Int64", "payload_bytes": "Int64"})
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=names).astype({"key": "Int64", "payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, (
        "record_id string, date string, url string, type string, refers_to string, digest string, payload_bytes long, key long, payload binary"))


def with_referred_key(records: DataFrame) -> DataFrame:
    """``records`` as read, with refers_to_key, the key of the response that a revisit names."""
    responses = records.where("type = 'response'").groupBy(F.col("record_id").alias("named")).agg(F.max("key").alias("refers_to_key"))
    return records.join(responses, F.col("refers_to") == F.col("named"), "left").drop("named")


def convert_archives(arcs: DataFrame, path: str | None = None) -> str:
    """Convert ARC archives to WARC files, by default below the checkpoint folder; the folder is returned."""
    path = path or f"{checkpoint_folder(arcs.sparkSession).rstrip('/')}/pairrank/warc-{uuid.uuid4().hex}"
    write_warc(deduplicated(convert(arcs)), path)
    return path
