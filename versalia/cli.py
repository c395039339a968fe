"""Command line: list sources, show a licence, fetch, prepare, build and inspect lexicon plugins."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from .operators.prepare import KINDS
from .plans import plugins
from .sources import fetch as fetching
from .sources.files import records
from .sources.registry import SOURCES, LexiconError, require, source

ACKNOWLEDGEMENTS = sorted({s.acknowledgement for s in SOURCES.values() if s.acknowledgement})


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="versalia", description="Prepare, build and inspect lexicon plugins")
    verbs = top.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list-sources")
    verbs.add_parser("show-license").add_argument("source", choices=SOURCES)
    get, prep = verbs.add_parser("fetch"), verbs.add_parser("prepare")
    for verb in (get, prep):
        verb.add_argument("source", choices=SOURCES)
        verb.add_argument("--lang")
        for flag in ACKNOWLEDGEMENTS:
            verb.add_argument(flag, dest="acknowledged", action="append_const", const=flag)
    for option in ("--country", "--region", "--url"):
        get.add_argument(option)
    get.add_argument("--sample", action="store_true", help=argparse.SUPPRESS)
    get.add_argument("--output-dir", default="data/raw")
    prep.add_argument("--input", required=True)
    prep.add_argument("--output", required=True)
    prep.add_argument("--kind", required=True, choices=KINDS)
    build = verbs.add_parser("build-plugin")
    build.add_argument("input")
    build.add_argument("--format", required=True, choices=("json", "table"))
    build.add_argument("--output", required=True)
    verbs.add_parser("inspect-plugin").add_argument("path")
    return top


def list_sources() -> str:
    rows = [("id", "class", "recommendation", "purpose", "tags", "license")]
    rows += [(s.id, s.cls, "recommended" if s.recommended else "optional", s.about.purpose, ",".join(s.about.tags), s.about.license) for s in SOURCES.values()]
    return "\n".join("\t".join(r) for r in rows)


def show_license(name: str) -> str:
    s = source(name)
    guidance = "built-in download" if name in fetching.BUILT_IN else "give --url"
    told = {
        "class": s.cls, "license": s.about.license, "purpose": s.about.purpose, "plugin kinds": ", ".join(s.kinds), "acknowledgement": s.acknowledgement or "none required",
        "fetch guidance": guidance, "recommendation": "recommended" if s.recommended else "optional",
    }
    return "\n".join([f"{s.about.title} ({s.id})", *(f"{k}: {v}" for k, v in told.items())])


def run(arguments: list[str], spark: SparkSession | None = None) -> str:
    """What a command prints; a session is made only for commands that need one."""
    a = parser().parse_args(arguments)
    if a.verb == "list-sources":
        return list_sources()
    if a.verb == "show-license":
        return show_license(a.source)
    acknowledged = tuple(getattr(a, "acknowledged", None) or ())
    if a.verb in ("fetch", "prepare"):
        require(a.source, getattr(a, "kind", None), acknowledged)
    spark = spark or SparkSession.builder.appName("versalia").getOrCreate()
    if a.verb == "fetch":
        path = fetching.fetch(spark, a.source, a.output_dir, acknowledged, lang=a.lang, country=a.country, region=a.region, url=a.url, sample=a.sample)
        return f"wrote {source(a.source).about.title} data to {path}"
    if a.verb == "prepare":
        manifest = fetching.read_manifest(Path(a.input), a.source)
        locale = a.lang or "und"
        found = records(spark, a.source, Path(a.input).resolve().as_uri(), lang=a.lang)
        plugins.write_prepared(plugins.prepare(found, a.source, a.kind, locale, acknowledged), a.output, a.source, a.kind, locale, manifest)
        return f"wrote prepared lexicon to {a.output}"
    if a.verb == "build-plugin":
        return json.dumps(plugins.build_plugin(spark, a.input, a.output, a.format), indent=2)
    return "\n".join(f"{k}: {v}" for k, v in plugins.inspect_plugin(spark, a.path).items())


def main() -> None:
    import sys

    try:
        print(run(sys.argv[1:]))
    except LexiconError as e:
        sys.exit(str(e))


if __name__ == "__main__":
    main()
