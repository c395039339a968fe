import gzip
import io
import json
import random
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from versalia import cli
from versalia.functions import folding
from versalia.operators import prepare
from versalia.plans import plugins
from versalia.sources import fetch, files, samples
from versalia.sources.registry import SOURCES, LexiconError


def _rows(df):
    return sorted((r["canonical"], tuple(r["aliases"]), round(r["score"], 4)) for r in df.collect())


def _zip(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "."), text)
    return out.getvalue()


def _opener(pages):
    def opened(url):
        if url not in pages:
            raise OSError(url)
        return io.BytesIO(pages[url])

    return opened


@pytest.mark.parametrize("name", SOURCES)
def test_samples_fetch_and_parse(spark, tmp_path, name):
    flags = tuple(cli.ACKNOWLEDGEMENTS)
    path = fetch.fetch(spark, name, tmp_path, flags, sample=True, **({"lang": "de"} if name == "wiktionary" else {}))
    lang = "de" if name == "wiktionary" else None
    assert _rows(files.records(spark, name, path.as_uri(), lang=lang)) == _rows(samples.parse_sample(spark, name))
    told = fetch.read_manifest(path, name)
    assert told.sample and told.version == "deterministic-sample"
    with pytest.raises(LexiconError):
        fetch.read_manifest(path, "getty" if name != "getty" else "ror")


def test_archive_members(spark, tmp_path):
    geo = "\n".join(samples.LINES["geonames"])
    (tmp_path / "g.zip").write_bytes(_zip(readme__txt="no table", DE__txt="\n" + geo + "\n"))
    assert len(_rows(files.records(spark, "geonames", (tmp_path / "g.zip").as_uri()))) == 4
    (tmp_path / "r.zip").write_bytes(_zip(v1__json="[]", v1_schema_v2__json=samples.DOCUMENTS["ror"]))
    assert len(_rows(files.records(spark, "ror", (tmp_path / "r.zip").as_uri()))) == 2
    (tmp_path / "l.bin").write_bytes(gzip.compress(samples.DOCUMENTS["gleif"].encode()))
    assert len(_rows(files.records(spark, "gleif", (tmp_path / "l.bin").as_uri()))) == 2
    # two gzip members, and names that don't tell the compression
    both = b"".join(gzip.compress((x + "\n").encode()) for x in samples.LINES["wiktionary"])
    (tmp_path / "w.jsonl").write_bytes(both)
    (tmp_path / "p.jsonl.gz").write_text("\n".join(samples.LINES["wiktionary"]))
    want = _rows(samples.parse_sample(spark, "wiktionary"))
    for name in ("w.jsonl", "p.jsonl.gz"):
        assert _rows(files.records(spark, "wiktionary", (tmp_path / name).as_uri(), lang="de")) == want
    with pytest.raises(Exception, match="no member"):
        (tmp_path / "e.zip").write_bytes(_zip(a__pdf="x"))
        files.records(spark, "geonames", (tmp_path / "e.zip").as_uri()).collect()


def test_plans():
    assert fetch.built_in("geonames", country="de").urls[0].endswith("/DE.zip")
    assert fetch.output_name("geonames", fetch.built_in("geonames").suffix) == "geonames-allcountries.tsv"
    assert len(fetch.built_in("ud-german-gsd").urls) == 3
    assert fetch.built_in("wiktionary", lang="EN").version == "kaikki-en"
    for name, lang in (("cldr", None), ("wiktionary", None), ("wiktionary", "xx"), ("gnd", None)):
        with pytest.raises(LexiconError):
            fetch.built_in(name, lang=lang)
    assert fetch.resolve("gnd", url="http://x", region="EU").suffix == "eu"
    assert fetch.output_name("discogs", "Custom") == "discogs-custom.xml.gz"


def test_downloads_merge_and_clean_up(spark, tmp_path):
    plan = fetch.built_in("ud-german-gsd")
    pages = {u: "\n".join(samples.LINES["ud-german-gsd"]).rstrip("\n").encode() for u in plan.urls}
    path = fetch.fetch(spark, "ud-german-gsd", tmp_path / "a", tuple(cli.ACKNOWLEDGEMENTS), _opener(pages))
    assert len(_rows(files.records(spark, "ud-german-gsd", path.as_uri()))) == 9
    plan = fetch.built_in("cldr", lang="de")
    docs = {u: samples.DOCUMENTS["cldr"].encode() for u in plan.urls}
    path = fetch.fetch(spark, "cldr", tmp_path / "b", (), _opener(docs), lang="de")
    assert isinstance(json.loads(path.read_text()), list)
    assert _rows(files.records(spark, "cldr", path.as_uri())) == _rows(samples.parse_sample(spark, "cldr"))
    with pytest.raises(OSError):
        fetch.fetch(spark, "ud-german-gsd", tmp_path / "c", tuple(cli.ACKNOWLEDGEMENTS), _opener(dict(list(pages.items())[:2])))
    with pytest.raises(LexiconError):
        fetch.fetch(spark, "getty", tmp_path / "c", (), _opener({"u": b"[]"}), url="u")
    assert not list((tmp_path / "c").iterdir())
    with pytest.raises(LexiconError):
        fetch.fetch(spark, "wiktionary", tmp_path, sample=True)


@pytest.mark.parametrize("form", ["json", "table"])
def test_command_line(spark, tmp_path, form):
    at = lambda name: str(tmp_path / name)
    assert "musicbrainz-en.json" in cli.run(["fetch", "musicbrainz", "--sample", "--lang", "en", "--output-dir", at("raw")], spark)
    cli.run(["prepare", "musicbrainz", "--input", at("raw/musicbrainz-en.json"), "--output", at("p.json"), "--kind", "canonical-map", "--lang", "en"], spark)
    out = at("m.json" if form == "json" else "m")
    told = json.loads(cli.run(["build-plugin", at("p.json"), "--format", form, "--output", out], spark))
    assert told["format"] == form and len(told["checksum"]) == 64
    shown = dict(x.split(": ", 1) for x in cli.run(["inspect-plugin", out], spark).split("\n"))
    assert (shown["name"], shown["locales"], shown["sources"]) == ("musicbrainz-canonical-map", "en", "musicbrainz")
    assert int(shown["entries"]) == len(json.loads((tmp_path / "p.json").read_text())["payload"]["payload"])


def test_listing():
    assert len(cli.run(["list-sources"]).split("\n")) == 16
    assert "--acknowledge-odbl" in cli.run(["show-license", "openstreetmap"])
    with pytest.raises(LexiconError):
        cli.run(["prepare", "wiktionary", "--input", "a", "--output", "b", "--kind", "word-set"])


MALFORMED = {
    "wiktionary": "{broken", "wikidata": "{\"entities\": {", "discogs": "<artists><artist><name>x</name>", "gleif": "<a><b></a>", "ror": "[{\"name\": ", "musicbrainz": "nothing", "natural-earth": "{\"type\": \"x\"}",
    "ud-german-gsd": "1\tonly\tthree", "geonames": "1\tonly", "openstreetmap": "{}", "orcid": "{broken", "gnd": "[", "getty": "{", "cldr": "{", "dbpedia": "[",
}


@pytest.mark.parametrize("name", sorted(MALFORMED))
def test_malformed_input_is_an_error(spark, tmp_path, name):
    assert set(MALFORMED) == set(SOURCES)
    (tmp_path / "x").write_text(MALFORMED[name])
    with pytest.raises(Exception, match="."):
        files.records(spark, name, (tmp_path / "x").as_uri(), lang="de" if name == "wiktionary" else None).collect()


@pytest.mark.parametrize("name", sorted(SOURCES))
def test_null_blank_and_repeated_input(spark, name):
    column = "value" if name in samples.LINES else "payload"
    given = samples.LINES[name] if name in samples.LINES else [samples.DOCUMENTS[name]]
    options = {"lang": "de"} if name == "wiktionary" else {}
    once = samples.PARSERS[name](spark.createDataFrame([(x,) for x in given], f"{column} string"), **options)
    more = spark.createDataFrame([(None, "a", "x")] + [(x, "a", "x") for x in given] * 2, f"{column} string, canonical string, x string")
    twice = samples.PARSERS[name](more, **options)
    one_a_name = name in ("wiktionary", "cldr")
    assert _rows(twice) == sorted(_rows(once) * (1 if one_a_name else 2)) and twice.columns == ["canonical", "aliases", "score"]
    assert samples.PARSERS[name](more.limit(0), **options).count() == 0


def test_later_records_have_greater_numbers(spark, tmp_path):
    for k, n in enumerate((3, 400, 20)):
        names = [samples.LINES["geonames"][1].replace("Tarn", f"Tarn{'x' * (k % 2)} {k} {i}") for i in range(n)]
        (tmp_path / f"{k}.tsv").write_text("\n".join([*names, samples.LINES["geonames"][1].replace("Tarn", "TARN" if k < 2 else "Tarn")]) + "\n")
    rows = sorted(files.records(spark, "geonames", tmp_path.as_uri()).collect(), key=lambda r: r["rec_idx"])
    assert [r["canonical"] for r in rows if r["canonical"].lower() == "tarn"] == ["TARN", "TARN", "Tarn"]
    assert [int(r["canonical"].split(" ")[2]) for r in rows if " " in r["canonical"]] == [*range(3), *range(400), *range(20)]
    built = prepare.build(files.records(spark, "geonames", tmp_path.as_uri()), "canonical-map")
    assert built.filter("key = 'tarn'").first()["value"] == "Tarn"


def test_wikidata_labels_of_other_languages(spark):
    got = {lang: [(c, a) for c, a, _ in _rows(samples.PARSERS["wikidata"](samples.sample(spark, "wikidata"), lang=lang))] for lang in ("de", "fr")}
    assert got["de"] == [("Itäsaari", ()), ("Nordwick-Damm", ())]
    assert got["fr"] == [("Itäsaari", ()), ("Northwick Dam", ("barrage de Northwick",))]


def plain_fold(name, spell):
    """A letter at a time."""
    import regex

    strip = folding._table(folding.STRIPPED)
    table = strip | folding._table(folding.SPELLED) if spell else strip
    return "".join(table.get(c, c) for x in unicodedata.normalize("NFC", name) for c in x.lower() if regex.match(r"[\p{Alphabetic}\p{N}]", c))


def test_folding_agrees_with_a_plain_loop(spark):
    rng = random.Random(4)
    letters = [chr(c) for c in (*range(32, 0x250), *range(0x300, 0x310), *range(0x370, 0x400), *range(0x400, 0x460), 0x1EBF, 0x1100, 0x1161, 0x212A, 0x212B, 0xFB1D, 0x958)] + ["Σ", "ς", "İ"]
    names = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(500)] + ["Mu\u0308nchen", "Strasse", "Straße", "Łódź", "Ærøskøbing", "Đakovo", "œuvre", "Þór", "мой", "ế", "e\u0302\u0301"]
    df = folding.composed(spark.createDataFrame([(n, n) for n in names], "name string, c string"), "c")
    for r in df.select("name", folding.folded(F.col("c"), False).alias("a"), folding.folded(F.col("c"), True).alias("b")).collect():
        assert (r["a"], r["b"]) == (plain_fold(r["name"], False), plain_fold(r["name"], True)), r["name"]
    assert plain_fold("Straße", False) == "strasse" and plain_fold("Łódź", False) == "lodz" and plain_fold("Ærøskøbing", True) == "aeroeskoebing" and plain_fold("мой", False) == "мой"


def test_lexicons_of_null_and_repeated_records(spark):
    rows = [(1, "Łódź", ["Lodz", None, "łódź"], 1.0, "x"), (1, "Łódź", ["Lodz", None, "łódź"], 1.0, "x"), (2, None, ["a"], 1.0, "x"), (3, "Tarn", None, 2.0, "x")]
    records = spark.createDataFrame(rows, "rec_idx int, canonical string, aliases array<string>, score float, key string")
    assert sorted((r["key"], r["value"]) for r in prepare.build(records, "canonical-map").collect()) == [("lodz", "Łódź"), ("tarn", "Tarn"), ("łódź", "Łódź")]
    assert all(prepare.build(records.limit(0), kind).count() == 0 for kind in prepare.KINDS)
    assert {r["key"] for r in prepare.build(records, "word-set").collect()} >= {"lodz", "łódź", "tarn"}


def plain_entries(records):
    """The entries of each record, a pair of names at a time."""
    for n, c, aliases, score in records:
        yield n, score, c.lower(), c
        for a in aliases:
            if any(plain_fold(a, x) == plain_fold(c, y) for x in (False, True) for y in (False, True)):
                yield n, score, a.lower(), c
            elif a != a.lower():
                yield n, score, a.lower(), a


def test_lexicons_agree_with_a_plain_loop(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice(["a", "A", "ä", "Ae", "e\u0301", "é", "E", "ß", "ss", " ", "-", "й", "2"]) for _ in range(rng.randint(1, 3)))
    records = [(n, name(), [name() for _ in range(3)], rng.choice([1.0, 2.0, 2.5])) for n in range(400)]
    df = spark.createDataFrame(records, "rec_idx long, canonical string, aliases array<string>, score float").withColumn("alias", F.lit("not read"))
    last, ranked = {}, {}
    for n, score, key, value in plain_entries(records):
        last[key] = max(last.get(key, (-1, "")), (n, value))
        ranked.setdefault(key, set()).add((-score, value))
    assert {r["key"]: r["value"] for r in prepare.build(df, "canonical-map").collect()} == {k: v for k, (_, v) in last.items()}
    lists = {k: [x for before, x in zip([(0, None), *sorted(v)], sorted(v), strict=False) if before[1] != x[1]] for k, v in ranked.items()}
    got = sorted((r["key"], r["ord"], r["value"], r["score"]) for r in prepare.build(df, "ranked-candidates").collect())
    assert got == sorted((k, n, v, -s) for k, x in lists.items() for n, (s, v) in enumerate(x))


@pytest.mark.parametrize("kind", ["canonical-map", "multiword-map", "ranked-candidates"])
def test_names_are_folded_once_for_all_records_that_have_them(spark, kind):
    records = spark.range(9).selectExpr("id AS rec_idx", "concat('Ärø ', id % 2) AS canonical", "array('aeroe 0', 'Ärö 1') AS aliases", "1.0F AS score")
    lines = prepare.build(records, kind)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    below, folding_ = None, 0
    for line in lines:
        if below is not None and depth(line) <= below:
            below = None
        assert below is None or not any(x in line for x in ("regexp_replace", "RLIKE", "translate")), line
        folding_ += "regexp_replace" in line
        if below is None and line.lstrip(" :+-").startswith("Aggregate [canonical"):
            below = depth(line)
    assert folding_ and any("Aggregate [canonical" in x for x in lines)


def test_documents_of_too_many_entries(spark, tmp_path, monkeypatch):
    lexicon = spark.createDataFrame([("word-set", "en", f"w{k}", None, None, 0) for k in range(9)], "kind string, locale string, key string, value string, score float, ord int")
    monkeypatch.setattr(plugins, "MOST_ENTRIES", 8)
    with pytest.raises(LexiconError, match="table"):
        plugins.write_json_plugin(lexicon, str(tmp_path / "p.json"), "p", "word-set", "en")
    plugins.write_table_plugin(lexicon, str(tmp_path / "t"))
    assert plugins.read_table_plugin(spark, str(tmp_path / "t")).count() == 9
