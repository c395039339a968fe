"""Getting source data: download plans, transfer through part files, normal form, source manifest.

Downloads run on the driver and write files; they hold a chunk in memory, except for
documents that must be merged. The opener is a parameter, so tests need no network.
"""

from __future__ import annotations

import json
import shutil
from collections.abc import Callable
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import BinaryIO
from urllib.request import urlopen

from pyspark.sql import SparkSession

from .files import chunks, validate
from .registry import LexiconError, require, source
from .samples import DOCUMENTS, LINES

# Release tags, addresses and editions of the built-in downloads; file endings of the outputs.
CLDR_RELEASE = "47.0.0"
NATURAL_EARTH_RELEASE = "v5.1.2"
UD_RELEASE = "r2.13"
CLDR = "https://raw.githubusercontent.com/unicode-org/cldr-json/{release}/cldr-json/cldr-localenames-full/main/{lang}"
GEONAMES = "https://download.geonames.org/export/dump/{place}.zip"
NATURAL_EARTH = "https://raw.githubusercontent.com/nvkelso/natural-earth-vector/{release}/geojson"
UD = "https://raw.githubusercontent.com/UniversalDependencies/UD_German-GSD/{release}/"
WIKTIONARY = "https://kaikki.org/dictionary/downloads/{lang}/{lang}-extract.jsonl.gz"
WIKTIONARY_EN = "https://kaikki.org/dictionary/English/words/kaikki.org-dictionary-English-words.jsonl.gz"
WIKTIONARY_EDITIONS = ("cs", "de", "es", "fr", "it", "nl", "pl", "pt", "tr")
ENDINGS = {"geonames": "tsv", "ud-german-gsd": "conllu", "wiktionary": "jsonl.gz", "discogs": "xml.gz", "natural-earth": "geojson", "gleif": "xml"}

#: Sources whose downloads are unpacked or merged before they are kept.
NORMALIZED = ("geonames", "cldr", "natural-earth", "ror", "gleif", "ud-german-gsd")
BUILT_IN = ("geonames", "ud-german-gsd", "natural-earth", "cldr", "wiktionary")


@dataclass(frozen=True)
class Plan:
    urls: tuple[str, ...]
    source_url: str
    version: str
    suffix: str
    sample: bool = False


@dataclass(frozen=True)
class SourceManifest:
    source: str
    source_url: str
    version: str
    sample: bool


def built_in(name: str, lang: str | None = None, country: str | None = None) -> Plan:
    """The download of a source that has a fixed place."""
    if name not in BUILT_IN:
        raise LexiconError(f"no fixed address is known for {source(name).id}: give one")
    if name == "geonames":
        place = country.upper() if country else "allCountries"
        url = GEONAMES.format(place=place)
        return Plan((url,), url, place, place.lower())
    if name == "ud-german-gsd":
        base = UD.format(release=UD_RELEASE)
        return Plan(tuple(f"{base}de_gsd-ud-{part}.conllu" for part in ("train", "dev", "test")), base, UD_RELEASE, UD_RELEASE)
    if name == "natural-earth":
        base = NATURAL_EARTH.format(release=NATURAL_EARTH_RELEASE)
        return Plan((f"{base}/ne_110m_admin_0_countries.geojson", f"{base}/ne_10m_populated_places_simple.geojson"), base, NATURAL_EARTH_RELEASE, "world")
    if not lang:
        raise LexiconError(f"the address of {name} depends on a language: give one")
    low = lang.lower()
    if name == "cldr":
        base = CLDR.format(release=CLDR_RELEASE, lang=lang)
        return Plan((f"{base}/territories.json", f"{base}/languages.json"), base, CLDR_RELEASE, low)
    if low != "en" and low not in WIKTIONARY_EDITIONS:
        raise LexiconError(f"no edition of wiktionary in {lang} is known")
    url = WIKTIONARY_EN if low == "en" else WIKTIONARY.format(lang=low)
    return Plan((url,), url, f"kaikki-{low}", low)


def resolve(name: str, lang: str | None = None, country: str | None = None, region: str | None = None, url: str | None = None, sample: bool = False) -> Plan:
    """A sample, the given address, or the built-in download, in this order."""
    suffix = lambda other: (lang or country or region or other).lower()
    if sample:
        return Plan((), f"sample://versalia/{name}", "deterministic-sample", suffix("sample"), True)
    if url:
        return Plan((url,), url, "user-supplied", suffix("custom"))
    return built_in(name, lang, country)


def output_name(name: str, suffix: str) -> str:
    return f"{name}-{suffix.lower()}.{ENDINGS.get(name, 'json')}"


def manifest_path(path: Path) -> Path:
    return path.with_suffix(".source.json")


def read_manifest(path: Path, name: str) -> SourceManifest | None:
    """The manifest beside a payload, if there is one; it must name the same source."""
    beside = manifest_path(path)
    if not beside.exists():
        return None
    found = SourceManifest(**json.loads(beside.read_text("utf-8")))
    if found.source != name:
        raise LexiconError(f"the source manifest says {found.source}, not {name}")
    return found


def merge(name: str, parts: list[Path], path: Path) -> None:
    """Parts in the form the parser reads: documents merged, lines joined, the right archive member."""
    if name == "cldr":
        path.write_text(json.dumps([json.loads(p.read_bytes()) for p in parts], ensure_ascii=False), "utf-8")
    elif name == "natural-earth":
        loaded = [json.loads(p.read_bytes()) for p in parts]
        if not all(isinstance(x, dict) and isinstance(x.get("features"), list) for x in loaded):
            raise LexiconError("natural-earth: not a FeatureCollection")
        path.write_text(json.dumps({"type": "FeatureCollection", "features": [f for x in loaded for f in x["features"]]}, ensure_ascii=False), "utf-8")
    else:
        with path.open("wb") as out:
            for part in parts if name == "ud-german-gsd" else parts[:1]:
                last = b"\n"
                with part.open("rb") as f:
                    for chunk in chunks(f, name):
                        out.write(chunk)
                        last = chunk[-1:] or last
                if name == "ud-german-gsd" and last != b"\n":
                    out.write(b"\n")


def fetch(spark: SparkSession, name: str, folder: str | Path, acknowledged: tuple[str, ...] = (), opener: Callable[[str], BinaryIO] = urlopen, **wanted) -> Path:
    """Bring the data of a source to ``folder`` and write its manifest beside it; ``wanted`` as for :func:`resolve`.

    A failed transfer or payload without records leaves no file behind.
    """
    require(name, None, acknowledged)
    plan = resolve(name, **wanted)
    path = Path(folder) / output_name(name, plan.suffix)
    path.parent.mkdir(parents=True, exist_ok=True)
    if plan.sample:
        text = "\n".join(LINES[name]) + "\n" if name in LINES else DOCUMENTS[name]
        fresh = path.with_name(f"{path.name}.part0")
        fresh.write_text(text, "utf-8")
        if path.suffix == ".gz":
            _gzip(fresh)
        fresh.replace(path)
    else:
        _download(spark, name, plan, path, opener)
    manifest_path(path).write_text(json.dumps(asdict(SourceManifest(name, plan.source_url, plan.version, plan.sample)), indent=2), "utf-8")
    return path


def _gzip(path: Path) -> None:
    import gzip

    path.write_bytes(gzip.compress(path.read_bytes(), mtime=0))


def _download(spark: SparkSession, name: str, plan: Plan, path: Path, opener: Callable[[str], BinaryIO]) -> None:
    parts, merged = [], path.with_name(f"merged-{path.name}")
    try:
        for i, url in enumerate(plan.urls):
            parts.append(path.with_name(f"{path.name}.part{i}"))
            with opener(url) as response, parts[-1].open("wb") as out:
                shutil.copyfileobj(response, out)
        if name in NORMALIZED:
            merge(name, parts, merged)
        elif len(parts) == 1:
            parts[0].replace(merged)
        else:
            raise LexiconError(f"{name} takes one payload, not {len(parts)}")
        validate(spark, name, merged.resolve().as_uri())
        merged.replace(path)
    finally:
        for p in (*parts, merged):
            p.unlink(missing_ok=True)
