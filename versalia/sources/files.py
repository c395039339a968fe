"""Payload files of the sources as parser input: compression told by content, archive members chosen by source.

Files are opened by executors, one file a row; plain and ``.gz`` line files go straight to Spark's
text reader, which splits plain ones.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import LexiconError, source
from .samples import LINES, PARSERS

GZIP, ZIP = b"\x1f\x8b", b"PK"
#: Fewest columns of a line of the gazetteer.
GAZETTEER_COLUMNS = 19
CHUNK = 1 << 20


def _first_line(member: io.BufferedIOBase) -> bytes:
    return next((line for line in member if line.strip()), b"")


def _pick(archive: zipfile.ZipFile, name: str) -> str:
    """The member of a zip archive that holds the data of the source."""
    members = [m for m in archive.namelist() if not m.endswith("/")]
    if name == "geonames":
        for m in members:
            if m.endswith(".txt"):
                with archive.open(m) as f:
                    if _first_line(f).count(b"\t") + 1 >= GAZETTEER_COLUMNS:
                        return m
    elif name == "gleif":
        members = [m for m in members if m.endswith(".xml")]
    elif name == "ror":
        members = [m for m in members if m.endswith(".json")]
        members.sort(key=lambda m: "schema_v2" not in m)  # stable: the first of the newer layout, else the first
    if name == "geonames" or not members:
        raise LexiconError(f"{name}: no member of the archive holds its data")
    return members[0]


def _inflated(f: io.BufferedIOBase) -> Iterator[bytes]:
    """Content of a gzip stream of any number of members."""
    unpack = zlib.decompressobj(31)
    for chunk in iter(lambda: f.read(CHUNK), b""):
        while chunk:
            yield unpack.decompress(chunk)
            chunk = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)


def chunks(f: io.BufferedIOBase, name: str) -> Iterator[bytes]:
    """The data in a seekable file, in pieces of bounded size: a zip member, gunzipped bytes, or the file as it is."""
    head = f.read(2)
    f.seek(0)
    if head == ZIP:
        with zipfile.ZipFile(f) as archive, archive.open(_pick(archive, name)) as member:
            yield from iter(lambda: member.read(CHUNK), b"")
    elif head == GZIP:
        yield from _inflated(f)
    else:
        yield from iter(lambda: f.read(CHUNK), b"")


def _lines(parts: Iterable[bytes]) -> Iterator[str]:
    rest = b""
    for part in parts:
        *whole, rest = (rest + part).split(b"\n")
        yield from (x.removesuffix(b"\r").decode() for x in whole)
    if rest:
        yield rest.removesuffix(b"\r").decode()


def opened(spark: SparkSession, name: str, *paths: str) -> DataFrame:
    """Parser input of a source: ``value``, a line a row, or ``payload``, a document a row; ``at``, the file and place that it is from.

    Several files are several documents, or lines one after the other. An empty file is an
    empty document, or no line.
    """
    source(name)
    by_line = name in LINES
    column = "value" if by_line else "payload"
    if by_line and not _packed(spark, paths):
        return spark.read.text(list(paths)).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("at"))

    def run(batches):
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                parts = chunks(io.BytesIO(content), name)
                if not by_line:
                    yield pd.DataFrame({column: [b"".join(parts).decode()], "file": path})
                    continue
                held: list[str] = []
                for line in _lines(parts):
                    held.append(line)
                    if len(held) == 10_000:
                        yield pd.DataFrame({column: held, "file": path})
                        held = []
                yield pd.DataFrame({column: held, "file": path}, dtype=object)

    read = spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(run, f"{column} string, file string")
    return read.select(column, F.struct("file", F.lit(0).cast("long").alias("start")).alias("at"))


def _packed(spark: SparkSession, paths: tuple[str, ...]) -> bool:
    """Whether a file's first two bytes say other than its name: zip, or gzip without ``.gz``, or the reverse."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not fs.isFile(path):
            continue
        stream = fs.open(path)
        head = bytes(x & 255 for x in (stream.read(), stream.read()) if x >= 0)
        stream.close()
        if head == ZIP or (head == GZIP) != p.endswith(".gz"):
            return True
    return False


def records(spark: SparkSession, name: str, *paths: str, lang: str | None = None) -> DataFrame:
    """``(rec_idx, canonical, aliases, score)`` of the files of a source. ``rec_idx`` is greater for later records.

    It is (file, start of the split, place in the split), so it doesn't depend on how splits are dealt to tasks. Where a
    parser gives one row a name, names are in the order of their code points.
    """
    options = {"lang": lang} if name in ("wikidata", "wiktionary") else {}
    parsed = PARSERS[name](opened(spark, name, *paths), **options)
    if "at" in parsed.columns:  # records of a split stay in order and follow one another
        number = F.struct("at.file", "at.start", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("n"))
    else:
        number = F.struct(F.col("canonical").alias("file"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n"))
    return parsed.select(number.alias("rec_idx"), "canonical", "aliases", "score")


def validate(spark: SparkSession, name: str, *paths: str) -> None:
    """Raise if the files give no record; reads no more than the first one takes."""
    if records(spark, name, *paths).isEmpty():
        raise LexiconError(f"{name}: no record in the payload")
