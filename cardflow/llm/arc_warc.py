"""Legacy archive converter: ARC archives to WARC.

An ARC archive starts with a version block, ``filedesc://``, that names its
version; every record is one header line, whose fields depend on the version,
then as many bytes as the line declares.  Version 1 has five fields, version 2
ten.  Each record becomes a WARC/1.1 record with the same meaning: a type from
the record's scheme and protocol line, a date from the 14-digit one, a digest
of the payload, and an identifier derived from what the record says, so the
conversion can be repeated.  Records with equal payloads are written once: the
one of the largest page is a response, the others revisit it.

Archives are bounded in bytes (a record is never cut), and each record is a
gzip member of its own.  A WARC archive is written as a file by Spark's text
writer, whose line separator, a zero byte, is padding that gzip allows; so
archives can lie in any store that Spark reads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import quote, unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.session import materialize, scratch_path

ARCHIVE_BYTES = 8 << 20
LEVEL = 1
READ = 1 << 13
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122

# The field names of both header versions.
V1 = "URL IP-address Archive-date Content-type Archive-length"
V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
DATE = "20240115000000"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- ARC ---------------------------------------------------------------------

def arc_head(name: str, version: int) -> bytes:
    """The version block."""
    names = V1 if version == 1 else V2
    body = f"{version} 0 cardflow\n{names}\n".encode()
    url = f"filedesc://{name}"
    if version == 1:
        return f"{url} 0.0.0.0 {DATE} text/plain {len(body)}\n".encode() + body + b"\n"
    return f"{url} 0.0.0.0 {DATE} text/plain 200 - - 0 {name} {len(body)}\n".encode() + body + b"\n"


def arc_record(page_id: int | None, url: str | None, html: str | None, version: int, offset: int, name: str) -> bytes:
    """One record: its header line, an HTTP response and a line feed."""
    body = (html or "").encode("utf-8", "surrogatepass")
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n"
            f"X-Page-Id: {'' if page_id is None else page_id}\r\n\r\n").encode() + body
    address = quote((url or "").encode("utf-8", "surrogatepass"), safe="!#$%&'()*+,/:;=?@[]~") or "-"
    if version == 1:
        line = f"{address} 0.0.0.0 {DATE} text/html {len(http)}\n"
    else:
        line = f"{address} 0.0.0.0 {DATE} text/html 200 {payload_digest(body)} - {offset} {name} {len(http)}\n"
    return line.encode() + http + b"\n"


def _arc_archives(limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, parts, size, name, version = 0, [], 0, "", 1
        for b in batches:
            ids = b["page_id"].astype(object).where(b["page_id"].notna(), None)
            for page, url, html in zip(ids, b["url"], b["html"]):
                if not parts:
                    name, version = f"part-{number}.arc", 1 + number % 2
                    parts = [arc_head(name, version)]
                    size, number = len(parts[0]), number + 1
                parts.append(arc_record(None if page is None else int(page), url, html, version, size, name))
                size += len(parts[-1])
                if size >= limit:
                    yield pd.DataFrame({"path": [name], "content": [b"".join(parts)]})
                    parts = []
        if parts:
            yield pd.DataFrame({"path": [name], "content": [b"".join(parts)]})
    return run


def to_arc(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) as ARC archives (path, content), by
    turns of version 1 and 2."""
    return pages.select("page_id", "url", "html").mapInPandas(_arc_archives(archive_bytes), "path string, content binary")


#: What a header line holds after the URL: address, date, media type (it may
#: hold spaces, as the URL may), the fields of version 2, length.
_LINE = {5: re.compile(r"(?s)(.*?) (\S*) (\d{4,17}) (.*) (\d+)"),
         10: re.compile(r"(?s)(.*?) (\S*) (\d{4,17}) (.*?) (\d+|-) (\S+) (\S+) (\d+|-) (\S+) (\d+)")}
_NEXT = re.compile(rb"\n(?=[^\n ]+:[^\n]* \d{14} [^\n]* \d+\n)")


def header_fields(line: bytes, names: list[str]) -> dict:
    """A header line's fields by name (bytes as Latin-1 characters)."""
    m = _LINE[len(names)].fullmatch(line.removesuffix(b"\r").decode("latin-1"))
    if m is None:
        raise ValueError(f"an ARC header line without the {len(names)} fields expected")
    return dict(zip(names, m.groups()))


def read_arc(data: bytes, bad: list[dict] | None = None) -> Iterator[dict]:
    """The records of an archive (see ``_scan``)."""
    return (record for _, record in _scan(data, bad))


def _scan(data: bytes, bad: list[dict] | None) -> Iterator[tuple[int, dict]]:
    """The records of an archive and where they begin.  The version block decides which header
    lines follow.  A header line that has other fields, or a record shorter
    than it declares, is an error; with a list ``bad`` it is noted there
    (offset, line, error) and reading goes on at the next header line."""
    at, fields = 0, None
    while at < len(data):
        if data[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        try:
            end = data.find(b"\n", at)
            if end < 0:
                raise ValueError("an ARC header line without an end")
            line = data[at:end]
            if fields is None:
                if not line.startswith(b"filedesc://"):
                    raise ValueError("an ARC archive starts with a version block")
                names = (V1 if line.count(b" ") == 4 else V2).split(" ")
            else:
                names = fields
            head = header_fields(line, names)
            length = int(head["Archive-length"])
            body = data[end + 1:end + 1 + length]
            if len(body) != length:
                raise ValueError("an ARC record is shorter than it declares")
            if fields is None:
                version, declared = (body.split(b"\n") + [b""])[:2]
                fields = declared.decode("latin-1").strip("\r").split(" ")
                if fields != (V1 if version.split(b" ")[0] == b"1" else V2).split(" "):
                    raise ValueError("unknown ARC version")
                at = end + 1 + length
                continue
        except ValueError as e:
            if bad is None:
                raise
            bad.append({"offset": at, "line": data[at:at + 200].split(b"\n")[0].decode("latin-1"), "error": str(e)})
            following = _NEXT.search(data, at)
            if fields is None or following is None:
                return
            at = following.end()
            continue
        yield at, head | {"body": body}
        at = end + 1 + length


def _stamp(date: str) -> str:
    """An ARC date (14 digits, or more with parts of a second) as WARC has it."""
    try:
        return datetime.strptime(date[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ") if len(date) >= 14 else _no_date(date)
    except ValueError:
        return _no_date(date)


def _no_date(date: str) -> str:
    raise ValueError(f"an ARC date that is none: {date}")


def _checksum_fits(checksum: str, payload: bytes, digest: str) -> bool:
    """Whether a checksum of a known form (SHA-1 in base32 or hex, MD5 in
    hex) is the payload's; one of another form says nothing."""
    value = checksum.split(":", 1)[-1]
    if re.fullmatch("[0-9a-f]{32}", value):
        return hashlib.md5(payload).hexdigest() == value
    if re.fullmatch("[0-9a-f]{40}", value):
        return hashlib.sha1(payload).hexdigest() == value
    return re.fullmatch("[A-Z2-7]{32}", value) is None or value == digest


def _url(field: str) -> str:
    if field == "-":
        return ""
    raw = unquote_to_bytes(field.encode("latin-1"))
    try:
        return raw.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def convert(record: dict) -> dict:
    """The WARC meaning of an ARC record: type, date, identifier, payload and
    digests.  A date that is none, or a checksum that does not fit, is an
    error."""
    url, stamp = _url(record["URL"]), _stamp(record["Archive-date"])
    body: bytes = record["body"]
    http = re.match(rb"HTTP/\d", body) is not None
    cut = body.find(b"\r\n\r\n") if http else -1
    head, payload = (body[:cut + 4], body[cut + 4:]) if cut >= 0 else (b"", body)
    page = re.search(rb"(?im)^X-Page-Id: *(-?\d+)\r?$", head)
    digest = payload_digest(payload)
    if not _checksum_fits(record.get("Checksum", "-"), payload, digest):
        raise ValueError("an ARC record's checksum does not fit its payload")
    kind = "response" if http else "metadata" if record["URL"].startswith(("dns:", "metadata:")) else "resource"
    page_id = int(page.group(1)) if page else None
    return {"page_id": page_id, "url": url, "date": stamp, "mime": record["Content-type"], "kind": kind,
            "http": head, "payload": payload, "digest": digest,
            "record_id": f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {url} {stamp} {digest}')}>"}


def convert_all(data: bytes) -> tuple[list[dict], list[dict]]:
    """An archive's records, converted, and what could not be (offset, line,
    error)."""
    bad: list[dict] = []
    found = []
    for at, r in _scan(data, bad):
        try:
            found.append(convert(r))
        except ValueError as e:
            bad.append({"offset": at, "line": r["URL"], "error": str(e)})
    return found, bad


def _records(narrow: bool):
    columns = ["page_id", "digest", "record_id"] if narrow else [
        "page_id", "url", "date", "mime", "kind", "http", "payload", "digest", "record_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                found = pd.DataFrame(convert_all(data)[0])
                if len(found):
                    found["page_id"] = found["page_id"].astype("Int64")
                    yield found[columns]
    return run, ", ".join(f"{c} {'long' if c == 'page_id' else 'binary' if c in ('http', 'payload') else 'string'}"
                          for c in columns)


def read_records(archives: DataFrame, narrow: bool = False) -> DataFrame:
    """The converted records of ARC archives (content); ``narrow``: only
    page_id, digest and record_id.  What cannot be read as a record is left
    to ``read_errors``."""
    run, schema = _records(narrow)
    return archives.select("content").mapInPandas(run, schema)


def _errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, data in zip(b["path"], b["content"]):
            bad = pd.DataFrame(convert_all(data)[1])
            if len(bad):
                yield bad.assign(path=path)[["path", "offset", "line", "error"]]


def read_errors(archives: DataFrame) -> DataFrame:
    """What of ARC archives (path, content) is no record: path, offset, the
    header line and the error."""
    return archives.select("path", "content").mapInPandas(_errors, "path string, offset long, line string, error string")


# -- WARC --------------------------------------------------------------------

def _text(v) -> str:
    return quote(str(v).encode("utf-8", "surrogatepass"), safe="!#$%&'()*+,/:;=?@[]~<> ")


def warc_record(r: dict) -> bytes:
    """One record as a gzip member.  A revisit keeps the HTTP head, whose
    Content-Length is that of the full payload, and names what it revisits."""
    revisit = r["refers_id"] is not None
    block = r["http"] + (b"" if revisit else r["payload"])
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else r['kind']}", f"WARC-Record-ID: {r['record_id']}",
             f"WARC-Date: {r['date']}", f"WARC-Target-URI: {_text(r['url'])}",
             f"WARC-Payload-Digest: sha1:{r['digest']}", f"WARC-Block-Digest: sha1:{payload_digest(block)}",
             f"Content-Type: {'application/http; msgtype=response' if r['http'] else r['mime']}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {r['refers_id']}", f"X-Refers-To-Page: {r['refers_page']}"]
    lines.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _warc_archives(limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for b in batches:
            ids = b["refers_id"].where(b["refers_id"].notna(), None)
            pages = [None if v is None else int(b["refers_page"].iat[i]) for i, v in enumerate(ids)]
            for r in zip(b["kind"], b["record_id"], b["date"], b["url"], b["digest"], b["mime"], b["http"],
                         b["payload"], ids, pages):
                parts.append(warc_record(dict(zip(("kind", "record_id", "date", "url", "digest", "mime", "http",
                                                   "payload", "refers_id", "refers_page"), r))))
                size += len(parts[-1])
                if size >= limit:
                    yield pd.DataFrame({"archive": [b"".join(parts)]})
                    parts, size = [], 0
        if parts:
            yield pd.DataFrame({"archive": [b"".join(parts)]})
    return run


def write_warc(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write converted records (with refers_id and refers_page, null for a
    response) as archives below ``path``, a file each."""
    (records.mapInPandas(_warc_archives(archive_bytes), "archive binary")
     .select(F.col("archive").cast("string").alias("value"))
     .write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path))


def read_warc(data: bytes) -> Iterator[dict]:
    """The records of an archive: their headers and block, each checked
    against its declared length and digests."""
    at = 0
    view = memoryview(data)
    while at < len(data):
        if data[at] == 0:  # padding
            at += 1
            continue
        z, parts = zlib.decompressobj(31), []
        while not z.eof:  # a little at a time: what follows the member is handed back
            if at >= len(data):
                raise ValueError("a WARC record is cut")
            parts.append(z.decompress(view[at:at + READ]))
            at += min(READ, len(data) - at)
        at -= len(z.unused_data)
        raw = b"".join(parts)
        cut = raw.index(b"\r\n\r\n")
        first, *lines = raw[:cut].decode("ascii").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines)
        length = int(head["Content-Length"])
        block = raw[cut + 4:cut + 4 + length]
        if len(block) != length or raw[cut + 4 + length:] != b"\r\n\r\n":
            raise ValueError("a WARC record is not as long as it declares")
        if head["WARC-Block-Digest"] != f"sha1:{payload_digest(block)}":
            raise ValueError("a WARC block's digest does not fit")
        yield {"head": head, "block": block}


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for data in b["content"]:
            for r in read_warc(data):
                head, block = r["head"], r["block"]
                cut = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
                kind = head["WARC-Type"]
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                size = len(block) - cut
                if kind == "revisit":
                    size = int(re.search(rb"(?im)^Content-Length: *(\d+)\r?$", block).group(1))
                elif payload_digest(block[cut:]) != digest:
                    raise ValueError("a WARC payload's digest does not fit")
                page = re.search(rb"(?im)^X-Page-Id: *(-?\d+)\r?$", block[:cut])
                out.append((int(page.group(1)) if page else None, size, digest, kind,
                            int(head["X-Refers-To-Page"]) if kind == "revisit" else None, head["WARC-Record-ID"]))
        f = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"])
        yield f.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def read_archives(spark, path: str) -> DataFrame:
    """What the archives below ``path`` hold: page_id, payload_bytes,
    payload_digest (both of the full payload), record_type, refers_to (the
    response's page, for revisits) and record_id."""
    return (spark.read.format("binaryFile").load(path).select("content")
            .mapInPandas(_read_back, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                                     "refers_to long, record_id string"))


def convert_archives(archives: DataFrame, path: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Convert ARC archives (content) into WARC archives below ``path`` and
    read them back.  Of records with equal payloads of at least ``least``
    bytes the one with the largest page_id is the response.

    Null payloads are empty payloads; records without a page id are responses
    and revisit nothing; rows repeated with the same page_id and payload are
    one page, written as often as it comes, all of them alike; empty tables
    give empty results.
    """
    index = materialize(read_records(archives, narrow=True), "index")
    # payloads are counted by digest before anything wide moves
    of = (index.where(F.col("page_id").isNotNull()).groupBy("digest")
          .agg(F.max("page_id").alias("refers_page"), F.min("page_id").alias("other"),
               F.max_by("record_id", "page_id").alias("refers_id"))
          .where(F.col("other") < F.col("refers_page")).drop("other"))
    of = materialize(of, "repeats")
    wide = read_records(archives)
    # small tables of repeats are broadcast by their measured size; larger
    # ones meet the pages by page, so that no digest is a hot key
    revisits = materialize(index.join(of, "digest").where(F.col("page_id") < F.col("refers_page"))
                           .select("page_id", "digest", "refers_id", "refers_page").distinct(), "revisits")
    full = wide.join(revisits, ["page_id", "digest"], "left")
    if least:
        short = F.octet_length("payload") < least
        full = full.withColumns({c: F.when(~short, F.col(c)) for c in ("refers_id", "refers_page")})
    write_warc(full, path, archive_bytes)
    return read_archives(archives.sparkSession, path)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Pages as ARC archives, converted to WARC archives in the shared folder
    and read back; see ``convert_archives``."""
    path = scratch_path(pages.sparkSession, "warc")
    return convert_archives(to_arc(pages), path)
