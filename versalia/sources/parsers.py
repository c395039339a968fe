"""Parsers: payloads of upstream datasets to source records ``(canonical, aliases, score)``.

Document formats take ``payload string``, one whole document a row; line formats take ``value string``,
one line a row, as ``spark.read.text`` gives them (gzip included). Null payloads and lines, blank lines and
records without a name give nothing; repeated records are kept, but where a parser says that it
gives one row a name; an empty table gives no record. A payload or line that isn't of the format is an error.
A column ``at`` that says where a row comes from is passed on; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRINGS = "array<string>"


def _of(df: DataFrame, *columns: Column) -> DataFrame:
    """``columns``, and ``at`` if there is one."""
    return df.select(*(["at"] if "at" in df.columns else []), *columns)


def _holds(column: str, test: Column, otherwise: str) -> Column:
    """True; an error for a value of ``column`` that isn't null or blank and fails ``test``."""
    return F.assert_true(F.coalesce(F.trim(column) == "", F.lit(True)) | test, F.concat(F.lit(otherwise + ": "), F.left(F.coalesce(column, F.lit("")), F.lit(80)))).isNull()


def _checked(df: DataFrame, column: str = "payload") -> DataFrame:
    """``df`` without null and blank values of ``column``; one that isn't a JSON object or array is an error."""
    whole = F.json_object_keys(column).isNotNull() | F.json_array_length(column).isNotNull()
    return df.filter(F.trim(column) != "").filter(_holds(column, whole, "not JSON"))


def _json(df: DataFrame, schema: str) -> DataFrame:
    return _of(_checked(df), F.from_json("payload", schema).alias("j"))


def _either(df: DataFrame, item: str, *lists: str) -> DataFrame:
    """Items of a payload that is an array, an object with one of the ``lists``, or one bare item; column ``x``."""
    array = F.from_json("payload", f"array<struct<{item}>>")
    kept = [F.from_json("payload", f"struct<`{k}`: array<struct<{item}>>>")[k] for k in lists]
    alone = F.array(F.from_json("payload", f"struct<{item}>"))
    empty = F.expr(f"cast(array() as array<struct<{item}>>)")
    many = F.concat(*(F.coalesce(k, empty) for k in kept)) if kept else empty
    items = F.when(F.ltrim("payload").startswith("["), array).when(F.size(many) > 0, many).otherwise(alone)
    return _of(_checked(df), F.explode(items).alias("x"))


def _record(df: DataFrame, canonical: Column, aliases: Column, score: Column, keep: bool = False) -> DataFrame:
    """Records with a canonical form; aliases sorted and distinct, without the canonical unless ``keep``."""
    named = _of(df, canonical.alias("canonical"), aliases.alias("a"), score.cast("float").alias("score")).filter("canonical is not null and canonical <> ''")
    good = F.filter("a", lambda x: x.isNotNull() & (x != "") & (F.lit(keep) | (x != F.col("canonical"))))
    return _of(named, F.col("canonical"), F.array_sort(F.array_distinct(F.coalesce(good, F.expr(f"cast(array() as {_STRINGS})")))).alias("aliases"), F.col("score"))


def _flat(*parts: Column) -> Column:
    empty = F.expr(f"cast(array() as {_STRINGS})")
    return F.concat(*(F.coalesce(p, empty) for p in parts))


def _mixed(word: Column, yes: float, no: float) -> Column:
    return F.when(word.rlike(r"\p{IsLowercase}") & word.rlike(r"\p{IsUppercase}"), yes).otherwise(no)


def wikidata(df: DataFrame, lang: str | None = None) -> DataFrame:
    text = "struct<language: string, value: string>"
    e = _json(df, f"entities map<string, struct<labels: map<string, {text}>, aliases: map<string, array<{text}>>>>")
    e = _of(e, F.explode("j.entities").alias("id", "e"))
    label = lambda k: F.try_element_at("e.labels", F.lit(k))["value"]
    first = F.get(F.array_sort(F.map_entries("e.labels")), F.lit(0))["value"]["value"]
    canonical = F.coalesce(*([label(lang)] if lang else []), label("en"), label("de"), first)
    chosen = F.try_element_at("e.aliases", F.lit(lang)) if lang else F.flatten(F.map_values("e.aliases"))
    own = F.filter(F.map_values("e.labels"), lambda x: (x["language"] == F.lit(lang)) & (x["value"] != canonical)) if lang else None
    aliases = _flat(F.transform(chosen, lambda x: x["value"]), *([F.transform(own, lambda x: x["value"])] if lang else []))
    return _record(e, canonical, aliases, F.when(canonical.contains(" "), 1.5).otherwise(1.0), keep=True)


def geonames(df: DataFrame) -> DataFrame:
    rows = _of(df.filter((F.trim("value") != "") & ~F.col("value").startswith("#")), F.split("value", "\t").alias("c"))
    rows = rows.filter(F.assert_true(F.size("c") >= 19, F.lit("geonames: fewer than 19 columns")).isNull())
    c, code = (lambda i: F.get("c", F.lit(i))), F.get("c", F.lit(7))
    base = F.when(c(6) == "P", 3.0).when(c(6) == "A", 2.6).when(c(6) == "S", 2.2).when(c(6).isin("L", "T"), 1.8).otherwise(1.2)
    seat = F.when(code == "PPLC", 1.0).when(code.isin("PPLA", "PPLA2", "PPLA3", "PPLA4"), 0.6).when(code == "PPL", 0.3).otherwise(0.0)
    people = F.coalesce(c(14).try_cast("double"), F.lit(0.0))
    score = base + seat + F.when(people > 0, F.log10(people) / 10).otherwise(0.0)
    return _record(rows, c(1), F.transform(F.concat(F.array(c(2)), F.split(c(3), ",")), lambda x: F.trim(x)), score)


#: Elements below the root of a dump that are records; elements of a record that name it; and those that hold more names.
_RECORDS, _NAMES, _HOLDERS = ("artist", "label", "master", "release"), ("name", "title"), ("namevariations", "aliases")


def discogs(df: DataFrame) -> DataFrame:
    """The first name or title of a record is its canonical form. The document is read as a stream of elements."""
    place = "at " + df.schema["at"].dataType.simpleString() + ", " if "at" in df.columns else ""

    def names(payload: str):
        import io
        import re
        from xml.etree import ElementTree

        local = lambda tag: tag.rpartition("}")[2]
        bare = lambda text: re.sub(r" \([0-9]+\)\Z", "", (text or "").strip())
        path: list = []
        for event, x in ElementTree.iterparse(io.BytesIO(payload.encode()), ("start", "end")):
            if event == "start":
                path.append(x)
                continue
            path.pop()
            if len(path) == 1 and local(x.tag) in _RECORDS:
                shown = [bare(c.text) for c in x if local(c.tag) in _NAMES]
                more = [bare(c.text) for c in x if local(c.tag) == "realname"]
                more += [bare(n.text) for c in x if local(c.tag) in _HOLDERS for n in c if local(n.tag) == "name"]
                shown = [n for n in shown if n]
                if shown:
                    yield shown[0], sorted({n for n in shown + more if n} - {shown[0]})
                path[0].clear()  # records that were read are let go

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k, payload in enumerate(batch.column("payload")):
                found = list(names(payload.as_py())) if payload.as_py() else []
                for a in range(0, len(found), 10_000):
                    part = found[a : a + 10_000]
                    rows = [pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.list_(pa.string()))]
                    told = [batch.column("at").take(pa.array([k] * len(part)))] if place else []
                    yield pa.RecordBatch.from_arrays([*told, *rows], [*(["at"] if place else []), "canonical", "aliases"])

    read = _of(df, F.col("payload").cast("string").alias("payload")).mapInArrow(run, f"{place}canonical string, aliases {_STRINGS}")
    return read.withColumn("score", _mixed(F.col("canonical"), 2.0, 1.2).cast("float"))


def gleif(df: DataFrame) -> DataFrame:
    """Prefixes are taken off tags first, whatever they are."""
    bare = _of(df, F.regexp_replace("payload", r"(</?)[A-Za-z0-9_.-]+:", "$1").alias("payload"))
    text = "struct<_VALUE: string, _type: string>"
    names = f"Entity: struct<LegalName: string, OtherEntityNames: struct<OtherEntityName: array<{text}>>, TransliteratedOtherEntityNames: struct<TransliteratedOtherEntityName: array<{text}>>>"
    x = _of(bare.filter("payload is not null"), F.explode(F.from_xml("payload", f"LEIRecords struct<LEIRecord: array<struct<{names}>>>", {"mode": "FAILFAST"})["LEIRecords"]["LEIRecord"]).alias("x"))
    other = F.filter("x.Entity.OtherEntityNames.OtherEntityName", lambda n: ~n["_type"].eqNullSafe("PREVIOUS_LEGAL_NAME"))
    value = lambda n: F.trim(n["_VALUE"])
    canonical = F.trim("x.Entity.LegalName")
    return _record(x, canonical, _flat(F.transform(other, value), F.transform("x.Entity.TransliteratedOtherEntityNames.TransliteratedOtherEntityName", value)), _mixed(canonical, 2.0, 1.4))


def ror(df: DataFrame) -> DataFrame:
    x = _either(df, f"names: array<struct<value: string, types: {_STRINGS}>>, name: string, aliases: {_STRINGS}, labels: array<struct<label: string>>")
    good = F.filter("x.names", lambda n: ~F.array_contains(n["types"], "acronym"))
    shown = F.get(F.filter(good, lambda n: F.array_contains(n["types"], "ror_display")), F.lit(0))["value"]
    labels = F.transform("x.labels", lambda n: n["label"])
    canonical = F.when(F.col("x.names").isNotNull(), shown).otherwise(F.col("x.name"))
    return _record(x, canonical, F.when(F.col("x.names").isNotNull(), F.transform(good, lambda n: n["value"])).otherwise(_flat(F.col("x.aliases"), labels)), F.lit(1.8))


def cldr(df: DataFrame) -> DataFrame:
    names = "map<string, string>"
    x = _either(df, f"main: map<string, struct<localeDisplayNames: struct<territories: {names}, languages: {names}>>>")
    d = x.select(F.explode(F.map_values("x.main")).alias("m")).select(F.explode(F.array("m.localeDisplayNames.territories", "m.localeDisplayNames.languages")).alias("n")).select(F.explode("n").alias("code", "name"))
    kept = d.filter((F.col("name") != "") & (F.col("name") != F.col("code")) & F.col("name").rlike(r"\p{IsAlphabetic}")).select("name").distinct()
    return _record(kept, F.col("name"), F.array().cast(_STRINGS), F.lit(2.0))


def natural_earth(df: DataFrame) -> DataFrame:
    """Keys differ by case alone, so properties are read as a map; numbers are read apart, as texts of digits aren't numbers."""
    text, number = (F.from_json("payload", f"features array<struct<properties: {t}>>")["features"]["properties"] for t in ("map<string, string>", "struct<pop_max: double>"))
    some = _checked(df).filter(_holds("payload", text.isNotNull(), "natural-earth: no features"))
    told = _of(some, F.explode(F.arrays_zip(text.alias("p"), number.alias("n"))).alias("x"))
    p = _of(told, F.col("x.p").alias("p"), F.col("x.n.pop_max").alias("people"))
    of = lambda k: F.try_element_at("p", F.lit(k))
    country = of("NAME").isNotNull()
    people = F.coalesce("people", F.lit(0.0))
    score = F.when(country, 2.8).otherwise(2.0 + F.when(people > 0, F.log10(people) / 10).otherwise(0.0))
    return _record(p.filter(F.trim(F.coalesce(of("NAME"), of("name"))) != ""), F.coalesce(of("NAME"), of("name")), F.when(country, F.array(of("NAME_LONG"), of("ADMIN"))).otherwise(F.array(of("nameascii"), of("namealt"))), score)


def ud_german_gsd(df: DataFrame) -> DataFrame:
    rows = _of(df.filter((F.trim("value") != "") & ~F.col("value").startswith("#")), F.transform(F.split("value", "\t"), lambda x: F.trim(x)).alias("c"))
    rows = rows.filter(F.assert_true(F.size("c") == 10, F.lit("ud-german-gsd: a line of other than 10 columns")).isNull())
    c = lambda i: F.get("c", F.lit(i))
    kept = rows.filter(~c(0).rlike("[-.]") & c(3).isin("NOUN", "PROPN"))
    has = lambda col, s, w: F.when(col.contains(s), w).otherwise(0.0)
    score = F.when(c(3) == "PROPN", 3.0).otherwise(2.0) + has(c(5), "Case=Nom", 0.4) + has(c(5), "Number=Sing", 0.1) + has(c(5), "Gender=", 0.1)
    score = score + F.when(c(7).isin("nsubj", "obj", "obl", "nmod", "root", "appos"), 0.3).otherwise(0.0) + has(c(9), "NE=", 0.5)
    canonical = F.when(c(3) == "PROPN", c(1)).otherwise(F.concat(F.upper(F.left(c(2), F.lit(1))), F.substr(c(2), F.lit(2))))
    return _of(kept, canonical.alias("canonical"), F.array_distinct(F.array(c(1), c(2))).alias("aliases"), score.cast("float").alias("score"))


def gnd(df: DataFrame) -> DataFrame:
    """``variantName`` may be a string or lists in lists; a person's other names may be one or a list."""
    name = f"struct<personalName: {_STRINGS}, forename: {_STRINGS}, prefix: {_STRINGS}, surname: {_STRINGS}>"
    x = _either(df, f"preferredName: string, type: {_STRINGS}, variantName: string, preferredNameEntityForThePerson: {name}, variantNameEntityForThePerson: string, originalScriptNameOfThePerson: array<struct<`@value`: string>>", "member")
    full = lambda n: F.coalesce(F.get(n["personalName"], F.lit(0)), F.nullif(F.concat_ws(" ", n["forename"], n["prefix"], n["surname"]), F.lit("")))
    strings = F.regexp_extract_all(F.regexp_replace("x.variantName", r"\{[^{}]*\}", ""), F.lit(r'"(?:[^"\\]|\\.)*"'), 0)
    listed = F.json_array_length("x.variantName").isNotNull()
    variant = F.when(listed, F.from_json(F.concat(F.lit("["), F.array_join(strings, ","), F.lit("]")), _STRINGS)).otherwise(F.array("x.variantName"))
    others = F.from_json("x.variantNameEntityForThePerson", f"array<{name}>")
    kinds = F.col("x.type")
    has = lambda k: F.exists(kinds, lambda t: t == k)
    score = F.when(kinds.isNull(), 1.0).when(has("Person"), 2.0).when(has("PlaceOrGeographicName"), 1.8).otherwise(1.2)
    aliases = _flat(variant, F.transform(others, full), F.transform("x.originalScriptNameOfThePerson", lambda n: n["@value"]))
    return _record(x, F.coalesce("x.preferredName", full(F.col("x.preferredNameEntityForThePerson"))), aliases, score)


def orcid(df: DataFrame) -> DataFrame:
    """JSON or XML, told by the first character."""
    as_json = F.ltrim("payload").startswith("{")
    j = F.from_json("payload", "name struct<`given-names`: struct<value: string>, `family-name`: struct<value: string>>, `other-names` struct<`other-name`: array<struct<content: string>>>")
    at = lambda tag: F.xpath_string("payload", F.lit(f"//*[local-name()='{tag}']"))
    others = F.xpath("payload", F.lit("//*[local-name()='other-name']/*[local-name()='content']/text()"))
    whole = _holds("payload", ~as_json | F.json_object_keys("payload").isNotNull(), "orcid: not JSON")
    d = _of(df.filter("payload is not null").filter(whole), F.col("payload"), F.when(as_json, j).alias("j"), as_json.alias("is_json"))
    given = F.when(F.col("is_json"), F.col("j.name.`given-names`.value")).otherwise(F.when(~F.col("is_json"), at("given-names")))
    family = F.when(F.col("is_json"), F.col("j.name.`family-name`.value")).otherwise(F.when(~F.col("is_json"), at("family-name")))
    whole = d.filter(F.assert_true(F.coalesce(given, family).isNotNull(), F.lit("orcid: no name")).isNull())
    aliases = F.when(F.col("is_json"), F.transform("j.`other-names`.`other-name`", lambda n: n["content"])).otherwise(F.when(~F.col("is_json"), others))
    return _record(whole, F.concat_ws(" ", given, family), aliases, F.lit(1.5))


def musicbrainz(df: DataFrame) -> DataFrame:
    x = _either(df, "name: string, title: string, `sort-name`: string, disambiguation: string, aliases: array<struct<name: string>>", "artists", "releases", "works", "recordings")
    canonical = F.coalesce("x.name", "x.title")
    return _record(x, canonical, _flat(F.array("x.sort-name", "x.disambiguation"), F.transform("x.aliases", lambda n: n["name"])), _mixed(canonical, 2.0, 1.2))


def getty(df: DataFrame) -> DataFrame:
    x = _either(df, "_label: string, identified_by: array<struct<content: string>>")
    names = F.transform("x.identified_by", lambda n: n["content"])
    return _record(x, F.coalesce("x._label", F.get(names, F.lit(0))), names, F.lit(1.5))


def wiktionary(df: DataFrame, lang: str | None = None) -> DataFrame:
    """The best score of each surface, one row a surface; no aliases."""
    e = _checked(df, "value").select(F.from_json("value", f"word string, pos string, lang_code string, forms array<struct<form: string, tags: {_STRINGS}>>").alias("e"))
    if lang:
        e = e.filter(F.lower("e.lang_code") == lang.lower())
    left_out = F.array(*(F.lit(t) for t in ("inflection-template", "table-tags", "class", "romanization")))
    forms = F.filter("e.forms", lambda f: ~F.coalesce(F.arrays_overlap(f["tags"], left_out), F.lit(False)))
    white = r"[\p{IsWhite_Space}]+"
    bare = lambda s: F.regexp_replace(s, rf"^{white}|{white}$", "")
    usable = lambda s: s.isNotNull() & s.rlike(r"[\p{IsAlphabetic}\p{N}]") & ~bare(s).rlike(r"[\t\n]")
    surfaces = F.array_sort(F.array_distinct(F.filter(_flat(F.array("e.word"), F.transform(forms, lambda f: f["form"])), usable)))
    pos = F.lower("e.pos")
    base = F.when(pos.isin("name", "proper noun", "proper-noun"), 2.4).when(pos == "noun", 2.0).when(pos.isin("adj", "adjective"), 1.6).when(pos == "verb", 1.5).when(pos.isin("adv", "adverb"), 1.2).otherwise(1.0)
    base = base + F.when(F.col("e.word").rlike(r"^\p{IsUppercase}"), 0.2).otherwise(0.0)
    each = e.select(base.alias("base"), F.posexplode(surfaces).alias("i", "s"))
    best = each.groupBy("s").agg(F.max(F.col("base") + F.when(F.col("i") == 0, 0.15).otherwise(0.0)).alias("score"))
    return _record(best, F.col("s"), F.array().cast(_STRINGS), F.col("score"))


def dbpedia(df: DataFrame) -> DataFrame:
    bare = lambda n: F.regexp_replace(n, "</?[Bb]>", "")
    docs = F.from_json("payload", f"docs array<struct<label: {_STRINGS}, redirectlabel: {_STRINGS}, score: {_STRINGS}>>")["docs"]
    told = _of(_checked(df), F.col("payload"), docs.alias("docs"))
    x = _of(told, F.explode("docs").alias("x"))
    found = _record(x, bare(F.get("x.label", F.lit(0))), F.transform("x.redirectlabel", bare), F.coalesce(F.get("x.score", F.lit(0)).try_cast("float"), F.lit(1.0)))
    graph = _of(told.filter(F.coalesce(F.size("docs"), F.lit(0)) <= 0), F.explode(F.from_json("payload", "map<string, map<string, array<struct<value: string>>>>")).alias("subject", "p"))
    ends = lambda *names: F.flatten(F.map_values(F.map_filter("p", lambda k, _: F.greatest(*(F.lower(k).endswith(n) for n in names)))))
    labels, aliases = F.transform(ends("label", "name"), lambda v: bare(v["value"])), F.transform(ends("alias", "aliases"), lambda v: bare(v["value"]))
    return found.unionByName(_record(graph, F.array_min(labels), _flat(labels, aliases), F.lit(1.0)))


def openstreetmap(df: DataFrame) -> DataFrame:
    item = "name: string, display_name: string, importance: double, place_rank: bigint, namedetails: map<string, string>"
    array = df.filter(_holds("payload", F.ltrim("payload").startswith("["), "openstreetmap: not an array"))
    x = _of(_checked(array), F.explode(F.from_json("payload", f"array<struct<{item}>>")).alias("x"))
    canonical = F.coalesce("x.name", F.trim(F.split("x.display_name", ",")[0]))
    named = x.filter(F.assert_true(canonical.isNotNull(), F.lit("openstreetmap: an object without a name")).isNull())
    score = 1.0 + F.coalesce("x.importance", F.lit(0.0)) + F.coalesce(F.col("x.place_rank") / 100, F.lit(0.0))
    return _record(named, canonical, _flat(F.array("x.display_name"), F.map_values("x.namedetails")), score)
