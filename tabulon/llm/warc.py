"""Web archives in ZIP packages: written by tasks, read by ranges without extraction."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.llm.common import written
from tabulon.session import scratch_dir

#: Payloads below this size are always stored whole.
MIN_REVISIT = 1000
#: A package is closed beyond this size and a further one begun.
PACKAGE_BYTES = 256 << 20
#: Neighbouring records are read together up to this size.
READ_BYTES = 4 << 20
#: A reading task takes whole stretches of packages, about so many records.
STRETCH_BYTES, TASK_RECORDS = 4 << 20, 10_000

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Fixed values of the WARC and ZIP formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


# --- writing


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit that names the page holding its payload."""
    sha1 = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "" if page is None else page
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 1, mtime=0)


def package(path: str, rows: Iterator[tuple], most: int) -> int:
    """Write records to one ZIP package until ``most`` bytes; members are stored, the index last."""
    fs, name = opened(path)
    lines, at = [], 0
    with fs.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as pack:
        with pack.open(DATA, "w", force_zip64=True) as data:
            for page, url, payload, refers_to in rows:
                member = record(page, url, payload, refers_to)
                data.write(member)
                lines.append(f"{urllib.parse.quote(url or '', safe=':/?#')} {DATE} " + json.dumps({"offset": at, "length": len(member), "filename": DATA.split("/")[-1]}))
                at += len(member)
                if at >= most:
                    break
        pack.writestr(INDEX, "".join(f"{line}\n" for line in sorted(lines)))
        pack.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA}, {"path": INDEX}]}))
    return len(lines)


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record for every row of ``page_id``, ``url``, ``html``; returns the packages' ``path`` and ``records``.

    Of records with equal payloads of at least 1,000 bytes, that with the largest
    ``page_id`` is a response and the others revisit it; equal largest ids are all
    responses, and so are rows without id. A null html is an empty payload. Other
    columns are ignored. Packages of lost or repeated tasks have names of their own
    and are not in the result, which is kept in the shared folder.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    given = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    same = given.where((F.octet_length("payload") >= MIN_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
    shared = same.where("n > 1").select(F.col("digest").alias("__digest"), "holder")
    told = given.join(shared, F.col("digest") == F.col("__digest"), "left").select("page_id", "url", "payload", F.when(F.col("page_id") < F.col("holder"), F.col("holder")).alias("refers_to"))
    fs, name = opened(folder)
    fs.create_dir(name, recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for batch in batches:
                for page, url, payload, refers_to in zip(batch["page_id"], batch["url"], batch["payload"], batch["refers_to"]):
                    yield None if pd.isna(page) else int(page), None if url is None else url, bytes(payload), None if pd.isna(refers_to) else int(refers_to)

        stream = rows()
        for first in stream:
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            yield pd.DataFrame({"path": [path], "records": [package(path, chain([first], stream), package_bytes)]})

    whole = told.select(F.col("page_id").cast("decimal(20,0)").cast("string").alias("page_id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))
    return written(whole.mapInPandas(write, "path string, records long"), "packages")


# --- reading


class Package:
    """Random access to the stored members of one ZIP file by range reads."""

    def __init__(self, path: str):
        fs, name = opened(path)
        self.file = fs.open_input_file(name)
        self.size = self.file.size()
        self.members = self.directory()

    def read(self, at: int, length: int) -> bytes:
        found = self.file.read_at(length, at)
        if len(found) != length:
            raise ValueError("the package ends too early")
        return found

    def directory(self) -> dict[str, tuple[int, int, int]]:
        """Name -> (method, offset of the local header, stored size) by the central
        directory, with ZIP64 fields where 16 or 32 bits are full."""
        tail_at = max(0, self.size - 22 - FULL16)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(END)
        while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(END, 0, end)
        if end < 0:
            raise ValueError("no ZIP directory")
        entries, length, start = struct.unpack_from("<HII", tail, end + 10)
        if FULL16 == entries or FULL32 in (length, start):
            locator = self.read(tail_at + end - 20, 20)
            if locator[:4] == LOCATOR64:
                head = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if head[:4] != END64:
                    raise ValueError("no ZIP64 directory")
                entries, length, start = struct.unpack_from("<QQQ", head, 32)
        found, listing, at = {}, self.read(start, length), 0
        for _ in range(entries):
            if listing[at : at + 4] != ENTRY:
                raise ValueError("broken ZIP directory")
            method, packed, size, n, extra, comment, offset = (struct.unpack_from(f, listing, at + k)[0] for f, k in (("<H", 10), ("<I", 20), ("<I", 24), ("<H", 28), ("<H", 30), ("<H", 32), ("<I", 42)))
            name = listing[at + 46 : at + 46 + n].decode("utf-8", "replace")
            fields, k = listing[at + 46 + n : at + 46 + n + extra], 0
            while k + 4 <= len(fields):
                tag, width = struct.unpack_from("<HH", fields, k)
                if tag == 1:  # in this order, and only what is full above
                    values = iter(struct.unpack_from(f"<{width // 8}Q", fields, k + 4))
                    size = next(values) if size == FULL32 else size
                    packed = next(values) if packed == FULL32 else packed
                    offset = next(values) if offset == FULL32 else offset
                k += 4 + width
            found[name] = (method, offset, packed)
            at += 46 + n + extra + comment
        return found

    def place(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member lie."""
        method, offset, size = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        head = self.read(offset, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"{name} has no local header")
        n, extra = struct.unpack_from("<HH", head, 26)
        return offset + 30 + n + extra, size


def parse_record(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers (lower-case names), HTTP header and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def list_records(packages: DataFrame) -> DataFrame:
    """``path``, ``at``, ``length`` of every record that the packages' indexes name; packages without index are an error."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                pack = Package(path)
                places = {name.split("/")[-1]: pack.place(name)[0] for name in pack.members if name.startswith("archive/")}
                start, size = pack.place(INDEX)
                spans = [json.loads(line.split(" ", 2)[2]) for line in pack.read(start, size).decode().splitlines()]
                yield pd.DataFrame({"path": path, "at": [places[s["filename"]] + s["offset"] for s in spans], "length": [s["length"] for s in spans]})

    return packages.select("path").mapInPandas(listed, "path string, at long, length long")


def page_of(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_packages(packages: DataFrame, payloads: bool = False) -> DataFrame:
    """Read all records back: ``page_id``, ``url``, ``payload_bytes``, ``payload_digest`` (hex),
    ``record_type``, ``refers_to`` and, if asked for, ``payload`` (null for revisits).

    Tasks read stretches of packages by ranges. A response's digest is computed
    from the payload read and must agree with its header.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, spans in batch.sort_values(["path", "at"]).groupby("path"):
                pack, rows, where = Package(path), [], list(zip(spans["at"], spans["length"]))
                while where:
                    n, end = 0, where[0][0]
                    while n < len(where) and where[n][0] == end and (n == 0 or end + where[n][1] - where[0][0] <= READ_BYTES):
                        end, n = end + where[n][1], n + 1
                    data, start = pack.read(int(where[0][0]), int(end - where[0][0])), where[0][0]
                    for at, length in where[:n]:
                        fields, http, payload = parse_record(data[at - start : at - start + length])
                        sha1, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != sha1:
                            raise ValueError(f"a payload in {path} is damaged")
                        told = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
                        url = fields.get("warc-target-uri")
                        rows.append((page_of(fields["warc-record-id"]), None if url is None else urllib.parse.unquote(url), told, base64.b32decode(sha1).hex(), kind, page_of(fields.get("warc-refers-to")), payload if payloads and kind == "response" else None))
                    where = where[n:]
                out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                out = out.astype({"page_id": "Int64", "refers_to": "Int64"})
                yield out if payloads else out.drop(columns="payload")

    stretch = (F.col("at") / STRETCH_BYTES).cast("long")
    records = packages.agg(F.sum("records")).first()[0] or 0
    spans = list_records(packages).repartition(max(1, -(-records // TASK_RECORDS)), "path", stretch)
    return spans.mapInPandas(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages to packages in the shared folder and read them back."""
    return read_packages(write_packages(pages, scratch_dir(spark, "wacz")))


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
holders AS (SELECT d, max(page_id) AS holder FROM p WHERE n >= {MIN_REVISIT} GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < holder THEN holder END AS refers_to
FROM p LEFT JOIN holders ON holders.d = p.d
"""
