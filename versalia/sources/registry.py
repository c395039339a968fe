"""The datasets lexicons are made from: class, recommendation, lexicon kinds, licence gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

COLUMNS = ("id", "class", "recommended", "kinds", "acknowledgement", "title", "license", "tags", "purpose")
_KINDS = {"C": "canonical-map", "M": "multiword-map", "P": "protected-forms", "W": "word-set", "R": "ranked-candidates"}


class LexiconError(ValueError):
    """A source, kind or licence acknowledgement that doesn't fit."""


@dataclass(frozen=True)
class Source:
    id: str
    cls: str
    kinds: tuple[str, ...]
    recommended: bool = True
    acknowledgement: str | None = None

    @property
    def about(self) -> About:
        return ABOUT[self.id]


@dataclass(frozen=True)
class About:
    """What a user should know before using a source."""

    title: str
    license: str
    tags: tuple[str, ...]
    purpose: str


# Id, class, kinds, recommended, flag that acknowledges the licence.
SOURCES = {
    s[0]: Source(s[0], s[1], tuple(_KINDS[k] for k in s[2]), *s[3:])
    for s in (
        ("wikidata", "green", "CM"), ("geonames", "yellow", "CM"), ("discogs", "green", "CMP"), ("gleif", "green", "CMP"), ("ror", "green", "CM"), ("cldr", "green", "CM"),
        ("natural-earth", "green", "CM", False), ("ud-german-gsd", "orange", "R", False, "--acknowledge-cc-by-sa"), ("gnd", "green", "CMP"), ("orcid", "green", "CM"),
        ("musicbrainz", "green", "CMP"), ("getty", "yellow", "CM", False), ("wiktionary", "orange", "WR", False, "--acknowledge-share-alike"),
        ("dbpedia", "orange", "CM", False, "--acknowledge-share-alike"), ("openstreetmap", "orange", "CM", False, "--acknowledge-odbl"),
    )
}

# Title, licence and tags of each source; the purpose is free text.
ABOUT = {
    k: About(title, licence, tuple(tags.split()), purpose)
    for k, title, licence, tags, purpose in (
        ("wikidata", "Wikidata", "CC0", "proper-nouns multilingual entities", "names of entities in many languages"),
        ("geonames", "GeoNames", "GeoNames attribution", "geography places", "place names with alternates"),
        ("discogs", "Discogs", "CC0", "music media", "artists, labels and releases"),
        ("gleif", "GLEIF", "CC0", "organizations companies", "legal names of companies"),
        ("ror", "ROR", "CC0", "organizations research", "research organizations"),
        ("cldr", "Unicode CLDR", "Unicode License v3", "locale names multilingual", "names of languages and territories"),
        ("natural-earth", "Natural Earth", "public domain", "geography places", "countries and large cities"),
        ("ud-german-gsd", "UD German GSD", "CC BY-SA 4.0", "german ranking nlp", "ranked German nouns"),
        ("gnd", "GND", "CC0", "authority names german", "authority records of persons, places and works"),
        ("orcid", "ORCID", "CC0", "people research", "names of researchers"),
        ("musicbrainz", "MusicBrainz", "CC0", "music media", "artists, releases and works"),
        ("getty", "Getty", "ODC-By 1.0", "arts culture", "art and culture vocabulary"),
        ("wiktionary", "Wiktionary", "CC BY-SA / GFDL", "lexical hints", "headwords and inflected forms"),
        ("dbpedia", "DBpedia", "share-alike derived data", "entities multilingual", "labels of a broad entity graph"),
        ("openstreetmap", "OpenStreetMap", "ODbL", "geography locality", "local place and street names"),
    )
}


def source(name: str) -> Source:
    if name not in SOURCES:
        raise LexiconError(f"unknown source: {name}")
    return SOURCES[name]


def require(name: str, kind: str | None = None, acknowledged: tuple[str, ...] = ()) -> Source:
    """The source, if it makes lexicons of that kind and its licence is acknowledged."""
    s = source(name)
    if s.acknowledgement and s.acknowledgement not in acknowledged:
        raise LexiconError(f"{name} requires {s.acknowledgement}")
    if kind is not None and kind not in s.kinds:
        raise LexiconError(f"{name} doesn't support {kind}")
    return s


def _rows() -> list[tuple]:
    return [(s.id, s.cls, s.recommended, ",".join(s.kinds), s.acknowledgement or "", s.about.title, s.about.license, ",".join(s.about.tags), s.about.purpose) for s in SOURCES.values()]


def sources_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_rows(), ", ".join(f"{c} {'boolean' if c == 'recommended' else 'string'}" for c in COLUMNS))


def oracle_sql() -> str:
    rows = ", ".join("(" + ", ".join(str(x).lower() if isinstance(x, bool) else f"'{x}'" for x in r) + ")" for r in _rows())
    return f"SELECT * FROM (VALUES {rows}) AS t({', '.join(COLUMNS)})"
