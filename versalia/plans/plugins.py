"""Lexicon plugins: JSON documents and compact Parquet tables with a metadata file beside them."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexicon as L
from ..operators import prepare as P
from ..sources.fetch import SourceManifest
from ..sources.registry import LexiconError, require, source

GENERATED = "1970-01-01T00:00:00Z"
NAMES = {"canonical-map", "multiword-map", "protected-forms"}


def prepare(records: DataFrame, name: str, kind: str, locale: str = "und", acknowledged: tuple[str, ...] = ()) -> DataFrame:
    """Records of the source ``name`` as a lexicon of the long form; a licence that needs acknowledgement is checked first."""
    require(name, kind, acknowledged)
    return P.build(records, kind).select(F.lit(kind).alias("kind"), F.lit(locale).alias("locale"), "key", "value", "score", "ord")


#: Entries of a lexicon that may become one document, which is made on the driver; larger ones are written as tables.
MOST_ENTRIES = 2_000_000


def _collected(lexicon: DataFrame) -> list:
    rows = lexicon.limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise LexiconError(f"more than {MOST_ENTRIES} entries: write the lexicon as a table")
    return rows


def _payload(rows: list, kind: str):
    if kind == "word-set":
        return sorted(r["key"] for r in rows)
    if kind == "ranked-candidates":
        out: dict = {}
        for r in sorted(rows, key=lambda r: (r["key"], r["ord"])):
            out.setdefault(r["key"], []).append({"value": r["value"], "score": r["score"]})
        return out
    return {r["key"]: r["value"] for r in sorted(rows, key=lambda r: r["key"])}


def _canonical(x) -> str:
    return json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def described(name: str, manifest: SourceManifest | None = None) -> dict:
    """License and provenance of what is made from a source."""
    s = source(name)
    return {
        "license": {"name": s.about.license, "summary": s.about.purpose, "acknowledgement_flag": s.acknowledgement},
        "sources": [{
            "id": name, "display_name": s.about.title, "url": manifest.source_url if manifest else f"source://versalia/{name}",
            "version": manifest.version if manifest else "user-supplied", "class": s.cls,
        }],
    }


def _dump(document: dict, path: str | Path) -> dict:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(document, ensure_ascii=False, indent=2), "utf-8")
    return document


def write_prepared(lexicon: DataFrame, path: str, name: str, kind: str, locale: str = "und", manifest: SourceManifest | None = None) -> dict:
    """A prepared lexicon of the source ``name`` as one document, made on the driver like a JSON plugin."""
    body = {"payload_kind": kind, "payload": _payload(_collected(lexicon), kind)}
    return _dump({"name": f"{name}-{kind}", "kind": kind, "locale": locale, **described(name, manifest), "generated_at": GENERATED, "payload": body}, path)


def _plugin(name: str, kind: str, locale: str, payload, about: dict) -> dict:
    checksum = hashlib.sha256(_canonical({"payload_kind": kind, "payload": payload}).encode()).hexdigest()
    return {"schema": {"major": 1, "minor": 0}, "name": name, "kind": kind, "locales": [locale], **about, "generated_at": GENERATED, "checksum": checksum, "payload_kind": kind, "payload": payload}


def write_json_plugin(lexicon: DataFrame, path: str, name: str, kind: str, locale: str) -> dict:
    """One document, made on the driver: for plugins that are to be shipped as a file, not for corpora."""
    return _dump(_plugin(name, kind, locale, _payload(_collected(lexicon), kind), {}), path)


def build_plugin(spark: SparkSession, prepared: str, path: str, form: str = "json") -> dict:
    """A prepared document as a plugin, JSON or table; returns the output's manifest.

    A table has a metadata file ``<path>.meta.json`` beside it, and its checksum is the payload's. A table is of the
    first locale alone (``und`` if there is none), a document of all.
    """
    given = json.loads(Path(prepared).read_text("utf-8"))
    payload = given["payload"]["payload"]
    document = _plugin(given["name"], given["kind"], given["locale"], payload, {k: given[k] for k in ("license", "sources")})
    if form == "json":
        _dump(document, path)
        checksum = hashlib.sha256(Path(path).read_bytes()).hexdigest()
    else:
        write_table_plugin(_frame(spark, given["kind"], document["locales"][:1] or ["und"], payload), path)
        _dump({k: v for k, v in document.items() if k not in ("payload", "payload_kind")}, f"{path}.meta.json")
        checksum = document["checksum"]
    return {"input": str(prepared), "output": str(path), "format": form, "checksum": checksum}


def inspect_plugin(spark: SparkSession, path: str) -> dict:
    """Name, kind, entries, locales, sources, license and checksum of a plugin: ``.json``, or else a table."""
    if Path(path).suffix == ".json":
        told = json.loads(Path(path).read_text("utf-8"))
        entries = len(told["payload"])
    else:
        told = json.loads(Path(f"{path}.meta.json").read_text("utf-8"))
        entries = read_table_plugin(spark, path).select("key").distinct().count()
    license_ = told.get("license") or {"name": "", "summary": ""}
    return {
        "name": told["name"], "kind": told["kind"], "entries": entries, "locales": ", ".join(told["locales"]), "sources": ", ".join(s["id"] for s in told.get("sources", [])),
        "license": f"{license_['name']}: {license_['summary']}", "checksum": told["checksum"],
    }


def read_json_plugin(spark: SparkSession, path: str) -> DataFrame:
    """The lexicon of a JSON plugin, for each of its locales."""
    document = json.loads(Path(path).read_text("utf-8"))
    return _frame(spark, document["payload_kind"], document["locales"], document["payload"])


def _frame(spark: SparkSession, kind: str, locales: list[str], payload) -> DataFrame:
    rows = [
        (kind, place, *row)
        for place in locales
        for row in (
            [(k, None, None, 0) for k in payload] if kind == "word-set"
            else [(k, c["value"], float(c["score"]), n) for k, cs in payload.items() for n, c in enumerate(cs)] if kind == "ranked-candidates"
            else [(k, v, None, 0) for k, v in payload.items()]
        )
    ]
    return spark.createDataFrame(rows, L.SCHEMA)


def write_table_plugin(lexicon: DataFrame, path: str) -> None:
    """Sorted by key, so that files and row groups have narrow key ranges."""
    lexicon.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def read_table_plugin(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(L.SCHEMA).parquet(path)


def inspect(lexicon: DataFrame) -> DataFrame:
    """Entries by kind and locale."""
    return lexicon.groupBy("kind", "locale").agg(F.countDistinct("key").alias("entries"))
