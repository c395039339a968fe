"""WARC archives: a gzip member per record, deduplicated by payload digest; a reader that salvages.

Spark's text writer puts the members down on any file system, with its commit protocol, so
a lost executor leaves no half file. What it writes between rows is an empty gzip member, which
concatenated gzip allows and readers skip.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, scratch_path, text_batches, until_exit

VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
#: Payloads of fewer bytes are always written out.
LEAST_SHARED = 100
#: Bytes of members that are written as one row, and such rows in a file.
BUNDLE, BUNDLES_A_FILE = 1 << 22, 64
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
MAGIC = b"\x1f\x8b\x08"
#: A later member or version line to go on from after damage.
NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
LINE = re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record: a response, or a revisit of page ``first`` without the payload."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += payload if first is None else b""
    head = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", uri),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        *([] if first is None else [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{first}>")]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + END


def member(data: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def matches(stated: str, data: bytes) -> bool | None:
    """Whether ``data`` has the digest ``stated`` as algorithm:value, in hex or base32; None for what can't be verified."""
    name, colon, value = stated.partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if not colon or name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None
    made = hashlib.new(name, data, usedforsecurity=False).digest()
    if len(value) == 2 * len(made):
        return value.lower() == made.hex()
    told = value.upper().rstrip("=")
    plain = base64.b32encode(made).decode().rstrip("=")
    return told == plain if len(told) == len(plain) else None


def payload_of(heads: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP head, if it is a HTTP message."""
    if not heads.get("content-type", "").lower().startswith("application/http"):
        return block
    return block.partition(END)[2]


def page_of(record_id: str) -> int | None:
    """The page id in a record id of this writer; other writers' ids have none."""
    page = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", record_id)
    return int(page[1]) if page and -(1 << 63) <= int(page[1]) < 1 << 63 else None


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``at``; ValueError says which check failed."""
    line = data.find(b"\r\n", at)
    if line < 0 or not re.fullmatch(rb"WARC/1\.[01]", data[at:line]):
        raise ValueError("version")
    stop = data.find(END, line)
    if stop < 0:
        raise ValueError("headers")
    heads = {}
    for x in data[line + 2 : stop].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = x.partition(":")
        if not colon:
            raise ValueError("headers")
        heads[name.strip().lower()] = value.strip()
    if not re.fullmatch(r"[0-9]{1,18}", heads.get("content-length", "")):
        raise ValueError("length")
    start = stop + len(END)
    end = start + int(heads["content-length"])
    if data[end : end + len(END)] != END:
        raise ValueError("length")
    block = data[start:end]
    if matches(heads.get("warc-block-digest", ""), block) is False:
        raise ValueError("digest")
    return heads, block, end + len(END)


def inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """(bytes, end, fault) of the gzip member at ``at``: with a fault, ``cut`` or ``damaged``, what it gave before."""
    z, parts, fed = zlib.decompressobj(31), [], at
    while not z.eof and fed < len(data):
        chunk, before = data[fed : fed + (1 << 16)], z.copy()
        try:
            parts.append(z.decompress(chunk))
        except zlib.error:
            # the failed call gave nothing; byte by byte all comes that stands before the fault
            with contextlib.suppress(zlib.error):
                for k in range(len(chunk)):
                    parts.append(before.decompress(chunk[k : k + 1]))
            return b"".join(parts), fed, "damaged"
        fed += len(chunk)
    return b"".join(parts), fed - len(z.unused_data), None if z.eof else "cut"


def walk(inner: bytes, damaged: bool) -> Iterator[tuple | str]:
    """(headers, block) of the records in inflated bytes; a reason for each run of bytes given up.

    What a damaged member gave may be wrong, so only records with a digest that matches count there.
    """
    at, lost = 0, False
    while at < len(inner):
        try:
            heads, block, end = parse(inner, at)
            if damaged and not (matches(heads.get("warc-block-digest", ""), block) or matches(heads.get("warc-payload-digest", ""), payload_of(heads, block))):
                raise ValueError("member")
        except ValueError as e:
            if not lost:
                yield str(e)
            lost = True
            later = LINE.search(inner, at + 1)
            at = later.start() if later else len(inner)
            continue
        yield heads, block
        at, lost = end, False


def salvage(data: bytes) -> Iterator[tuple]:
    """Walk through an archive's bytes, gzip members or plain records, in either order.

    Yields ``("record", start, end, headers, block)`` for each record that passes its checks and
    ``("gap", start, end, reason, None)`` for bytes given up: after a failed check the walk goes
    on at the next member or version line from which a whole record can be read. Inflated bytes
    are walked through alike, those of a broken member too; a gap among records of a member has
    the bytes of the member.
    """
    at, gap, why = 0, None, ""

    def step(at: int) -> tuple[int, list, bool]:
        if not data.startswith(MAGIC, at):
            heads, block, end = parse(data, at)
            return end, [(heads, block)], False
        inner, end, fault = inflate(data, at)
        found = list(walk(inner, fault == "damaged"))
        if fault:
            while found and isinstance(found[-1], str):  # the gap of the member follows
                found.pop()
            if not found:
                raise ValueError("member")
        return end, found, fault is not None

    while at < len(data):
        try:
            end, found, broken = step(at)
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            later = NEXT.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if all(isinstance(x, str) for x in found):  # an empty member by chance isn't a place to go on from
            if found and gap is None:
                gap, why = at, found[0]
            at = end
            continue
        if gap is not None:
            yield "gap", gap, at, why, None
            gap = None
        for x in found:
            yield ("gap", at, end, x, None) if isinstance(x, str) else ("record", at, end, *x)
        if broken:
            gap, why = at, "member"
            later = NEXT.search(data, at + 1)
            end = later.start() if later else len(data)
        at = end
    if gap is not None:
        yield "gap", gap, len(data), why, None


def first_of_equals(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` with ``digest`` and ``first``: the page whose payload it repeats, or null.

    Payloads of at least 100 bytes with equal digests share the response of their smallest page id;
    rows with that id (repeated rows too) and rows with a null id are responses themselves.
    """
    html = F.coalesce("html", F.lit(""))
    told = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    equal = told.filter((F.octet_length("html") >= LEAST_SHARED) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"))
    joined = salted_join(told, equal.filter("low < high").drop("high"), ["digest"], "page_id", "left")
    return joined.withColumn("first", F.when(F.col("page_id") > F.col("low"), F.col("low"))).drop("low")


def write_warc(pages: DataFrame, path: str, bundle: int = BUNDLE, bundles_a_file: int = BUNDLES_A_FILE) -> None:
    """Write a record per row of ``pages(page_id long, url string, html string)`` to archives under ``path``.

    Null html is an empty payload, null urls an empty target. Other columns are ignored; an
    empty table gives no archive with a record. A file ends after ``bundle * bundles_a_file`` bytes and
    what its last record takes, so that it can be read as a whole.
    """

    def run(batches):
        import pyarrow as pa

        def rows(members: list[bytes]) -> list[bytes]:
            whole = b"".join(members)
            return [whole, *[EMPTY_MEMBER] * (len(whole) // bundle)]  # the writer counts rows: a large one counts as several

        held, size = [], 0
        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first")), strict=True):
                held.append(member(record(x[0], x[1], x[2].encode(), x[3], x[4])))
                size += len(held[-1])
                if size >= bundle:
                    yield pa.RecordBatch.from_arrays([pa.array(rows(held), pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(rows(held), pa.binary())], ["value"])

    text_batches(pages.sparkSession, 500)
    typed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    members = first_of_equals(typed).select("page_id", "url", "html", "digest", "first").mapInArrow(run, "value binary")
    # bytes stay as they are: the cast doesn't decode, and this encoding has a character for every byte
    writer = members.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", bundles_a_file)
    writer.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def read_warc(spark, path: str) -> DataFrame:
    """Records and gaps of all archives under ``path``.

    ``(file, start, end, gap, record_type, page_id, target, refers_to, payload_bytes, payload_digest,
    payload)``: ``gap`` is null for a record, else the check that failed at the start of the
    quarantined bytes ``start``..``end`` of ``file``. Payloads are hashed again; one that doesn't match
    its header is a gap (``payload``). Digests are verified by the algorithm they name, in hex or
    base32; unknown ones and other forms count as unverified. ``payload_digest`` is the payload's
    SHA-256. Only HTTP messages have a head that isn't payload. A revisit has no payload; its size and
    digest are those in its headers. No file gives no row. Each file is read as a whole in one task, so it must be
    below 2 GB; :func:`write_warc` bounds its files by bytes.
    """

    def rows(file: str, data: bytes) -> Iterator[tuple]:
        for kind, start, end, x, block in salvage(data):
            if kind == "gap":
                yield file, start, end, x, *[None] * 7
                continue
            stated = x.get("warc-payload-digest", "")
            page, refers = page_of(x.get("warc-record-id", "")), page_of(x.get("warc-refers-to", ""))
            if x.get("warc-type") == "revisit":
                size = re.search(rb"(?i)\r\nContent-Length: *([0-9]+)", block.partition(END)[0])
                told = (int(size[1]) if size else None, stated.removeprefix("sha256:"), None)
            else:
                payload = payload_of(x, block)
                told = (len(payload), hashlib.sha256(payload).hexdigest(), payload)
                # a segment states the digest of the payload of all segments
                if "warc-segment-number" not in x and matches(stated, payload) is False:
                    yield file, start, end, "payload", *[None] * 7
                    continue
            yield file, start, end, None, x.get("warc-type"), page, x.get("warc-target-uri"), refers, *told

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([
            ("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()),
            ("target", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
        ])
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                held, size = [], 0
                for row in rows(file.as_py(), content.as_py() or b""):
                    held.append(row)
                    size += len(row[-1] or b"") + 200
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = "file string, start long, end long, gap string, record_type string, page_id long, target string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return files.mapInArrow(run, kinds)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: one row per page.

    Null ids, urls and html, repeated rows and an empty table as in :func:`write_warc`; other columns are ignored.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    until_exit(pages.sparkSession, path)
    return read_warc(pages.sparkSession, path).filter("gap is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
