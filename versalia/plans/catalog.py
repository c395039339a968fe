"""Registered queries of the recasing engine and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import casing as C
from ..functions.profiles import PROFILES
from ..operators import lexicon as L
from ..operators import prepare as P
from ..operators import recase as R
from ..operators.tokens import tokenize, tokens_of
from ..options import CaseMode, CaseOptions, GermanMode, SeparatorStyle
from ..sources import registry, samples
from . import oracle as O
from .source_sql import SOURCE_SQL

LANGS = ("en", "de", "fr", "es")
#: Stands for null languages and those without a profile.
NEUTRAL = "und"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.filter(F.col("lang") == lang) if lang else docs


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("key", "doc_id")


def language() -> Column:
    """The language of a row's ``lang`` if there is a profile for it; null and other languages have the neutral one."""
    primary = F.lower(F.split(F.translate("lang", "_", "-"), "-")[0])
    return F.when(primary.isin(*PROFILES), primary).otherwise(NEUTRAL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence case of every document under the rules of its language."""
    return _named(R.recase(_docs(spark, sf_dir), CaseOptions(locale=NEUTRAL), language=language()))


def recased(spark: SparkSession, sf_dir: str, options: CaseOptions, change: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """Documents of one language, their texts changed first."""
    docs = _docs(spark, sf_dir, options.language)
    return _named(R.recase(docs.withColumn("text", change(F.col("text"))), options))


def confidence_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("lang", "text")
    return R.recase(docs, CaseOptions(locale=NEUTRAL), key="lang", language=language()).groupBy(F.col("key").alias("lang"), "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("n_words"))


def token_counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("word", "space", "punct", "symbol")
    sums = R.facts(_docs(spark, sf_dir)).agg(*(F.sum(f"n_{k}").alias(k) for k in kinds))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds))).alias("x")).select("x.*").filter("n > 0")


def token_offsets_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(R.facts(_docs(spark, sf_dir)).filter("n_tokens > 0").select("key", F.col("n_tokens").alias("n"), "sum_end", "n_bytes"))


def reconstruct_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, empty and null ones too, whose tokens joined give their text."""
    same = F.array_join(tokens_of(F.col("text")), "").eqNullSafe(F.col("text"))
    return _docs(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_same"), F.sum(F.size(tokens_of(F.coalesce("text", F.lit(""))))).alias("n_tokens"))


def words_of_class(spark: SparkSession, sf_dir: str, of) -> DataFrame:
    return tokenize(_docs(spark, sf_dir), "doc_id", "text").filter(F.col("kind") == "word").filter(of(F.col("raw"))).groupBy(F.col("raw").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def sentence_counts(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    told = R.facts(_docs(spark, sf_dir, lang), CaseOptions(locale=lang)).filter("n_tokens > 0")
    return _named(told.select("key", "n_boundary", "n_starts", "last_sentence", "n_shouting", "n_title_like"))


def _rules(s: DataFrame) -> DataFrame:
    s = s.filter("rule <> 'WhitespaceCollapsed'")
    return s.groupBy("rule", "confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("n_changed"), F.sum(F.col("out_end") - F.col("out_start")).alias("out_bytes"))


def rule_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the English documents; :func:`rule_histogram_all` has those of every document."""
    return _rules(R.spans(_docs(spark, sf_dir, "en"), CaseOptions()))


def rule_histogram_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of every document under the rules of its language."""
    return _rules(R.spans(_docs(spark, sf_dir), CaseOptions(locale=NEUTRAL), language=language()))


def _placed(s: DataFrame) -> DataFrame:
    """Spans by document and rule, with sums that tell any of them apart that moves."""
    n = lambda c: F.sum(c).alias(f"sum_{c}")
    told = s.groupBy(F.col("key").alias("doc_id"), "rule", "confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("n_changed"), *(n(c) for c in ("src_start", "src_end", "out_start", "out_end")))
    return told


#: What is put behind each text, so that phrases, separators and runs of white space occur.
ADDED = " -  new york \n and Van der   Waals: san francisco; it 's the NEW york—end. Dr. Odo wrote Rust, not rust; see no. 7, 3.5 km etc. Then... And… so - IT ended  "


def word_counts(spark: SparkSession, sf_dir: str, where: str, *by: str, mode: CaseMode = CaseMode.SENTENCE) -> DataFrame:
    """Words of the English documents that meet a condition, counted by some of their columns."""
    docs = _docs(spark, sf_dir, "en").select("doc_id", F.concat("text", F.lit(ADDED)).alias("text"))
    return R.words(docs, CaseOptions(mode=mode)).filter(where).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def part_titles(spark: SparkSession, sf_dir: str, mode: CaseMode, text: str) -> DataFrame:
    part = table(spark, sf_dir, "part").selectExpr("p_partkey AS doc_id", f"{text} AS text")
    return _named(R.recase(part, CaseOptions(mode=mode)))


def geonames_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer lines made of parts, through the parser."""
    fields = ["p_partkey", "p_name", "p_name", "p_brand", "0", "0", "substr('PASLTH', 1 + p_size % 6, 1)", "element_at(array('PPLC', 'PPLA', 'PPLA4', 'PPL', 'X'), int(1 + p_partkey % 5))", "''", "''", "''", "''", "''", "''", "p_size * 1000", "''", "''", "''", "''"]
    lines = table(spark, sf_dir, "part").selectExpr(f"concat_ws('\t', {', '.join(fields)}) AS value")
    return samples.PARSERS["geonames"](lines).select("canonical", F.array_join("aliases", "|").alias("aliases"), F.round(F.col("score").cast("double"), 4).alias("score"))


def german_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated tokens made of parts, through the parser."""
    fields = ["'1'", "p_type", "p_name", "element_at(array('NOUN', 'PROPN', 'VERB'), int(1 + p_partkey % 3))", "'_'", "concat(if(p_size % 2 = 0, 'Case=Nom|', ''), if(p_size % 3 = 0, 'Gender=Fem|', ''), 'Number=', if(p_size % 5 = 0, 'Sing', 'Plur'))", "'0'", "element_at(array('nsubj', 'conj', 'obj', 'det'), 1 + p_size % 4)", "'_'", "if(p_size % 7 = 0, 'NE=B', '_')"]
    lines = table(spark, sf_dir, "part").selectExpr(f"concat_ws('\t', {', '.join(fields)}) AS value")
    return samples.PARSERS["ud-german-gsd"](lines).select("canonical", F.array_join("aliases", "|").alias("aliases"), F.round(F.col("score").cast("double"), 4).alias("score"))


def json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values of the JSON objects in the events."""
    walked = table(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string, string>")).alias("k", "v"))
    return walked.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("n_values"), F.min("v").alias("low"), F.max("v").alias("high"))


def spans_changed(spark: SparkSession, sf_dir: str, options: CaseOptions) -> DataFrame:
    docs = _docs(spark, sf_dir, options.language).select("doc_id", F.concat("text", F.lit(ADDED)).alias("text"))
    return _placed(R.spans(docs, options))


def analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, confidence and spans of the English documents in one row each, the spans counted."""
    docs = _docs(spark, sf_dir, "en").select("doc_id", F.concat("text", F.lit(ADDED)).alias("text"))
    a = R.sentence_case_analyze(docs, "en")
    changed = F.filter("spans", lambda x: x["changed"])
    ends = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["out_end"])
    return _named(a.select("key", "output", "confidence", F.size("spans").cast("long").alias("n_spans"), F.size(changed).cast("long").alias("n_changed"), ends.alias("sum_out_end")))


def checksum_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"))


def _entries(words: DataFrame, kind: str, locale: str, where: str, value: str, score: str = "NULL", number: int = 0) -> DataFrame:
    return words.filter(where).selectExpr(f"'{kind}' AS kind", f"'{locale}' AS locale", "key", f"{value} AS value", f"CAST({score} AS float) AS score", f"{number} AS ord")


def _met(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    return R.met_words(_docs(spark, sf_dir, lang), "text", lang)


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries for English words of the documents: canonical, protected before canonical, a locale before its language."""
    words = _met(spark, sf_dir, "en")
    parts = [
        _entries(words, "canonical-map", "en", "key RLIKE '^[a-m][a-z]{6}$'", "upper(key)"), _entries(words, "protected-forms", "en", "key RLIKE '^[a-d][a-z]{6}$'", "concat(upper(left(key, 2)), substr(key, 3))"),
        _entries(words, "canonical-map", "en-GB", "key RLIKE '^[c-e][a-z]{6}$'", "concat(key, 'X')"), _entries(words, "canonical-map", "de", "key RLIKE '^[a-z]{5}$'", "upper(key)"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def canonical_lookup(spark: SparkSession, sf_dir: str, locale: str) -> DataFrame:
    """English documents under a lexicon."""
    return _named(R.recase(_docs(spark, sf_dir, "en"), CaseOptions(locale=locale), lexicon=_lexicon(spark, sf_dir)))


def phrase_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two words, the first of a to m and the second of n to z; a canonical-map key of two words is no phrase."""
    words = _met(spark, sf_dir, "en")
    firsts, seconds = (words.filter(F.col("key").rlike(p)).agg(F.min("key").alias(f"{n}0"), F.max("key").alias(f"{n}1")) for n, p in (("a", "^[a-m][a-z]{2,4}$"), ("b", "^[n-z][a-z]{1,3}$")))
    ends = firsts.join(seconds).selectExpr("explode(array(concat(a0, ' ', b0), concat(a1, ' ', b1), 'and so', 'in the', 'it was', 'big red')) AS key")
    lexicon = _entries(ends, "multiword-map", "en", "key <> 'big red'", "concat(upper(key), '!')").union(_entries(ends, "canonical-map", "en", "key = 'big red'", "'dead key'"))
    docs = _docs(spark, sf_dir, "en").select("doc_id", F.concat("text", F.lit(" The and  so in the big red it was, and; so")).alias("text"))
    return _named(R.recase(docs, CaseOptions(), lexicon=lexicon))


def german_aggressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German documents in lower case under ranked candidates; those below the least score aren't taken."""
    words = _met(spark, sf_dir, "de")
    short = "key RLIKE '^[a-z]{5}$'"
    lexicon = _entries(words, "ranked-candidates", "de", short, "upper(key)", "1.5").union(_entries(words, "ranked-candidates", "de", short, "concat(key, 'a')", "1 + length(key) % 3", 1))
    lexicon = lexicon.union(_entries(words, "ranked-candidates", "de", "key RLIKE '^[a-z]{6}$'", "upper(key)", "0.5"))
    docs = _docs(spark, sf_dir, "de").withColumn("text", F.lower("text"))
    return _named(R.recase(docs, CaseOptions(locale="de", german_mode=GermanMode.AGGRESSIVE), lexicon=lexicon))


def word_set(spark: SparkSession, sf_dir: str, missing: bool) -> DataFrame:
    """Words of the part names that a set of words has, or lacks."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    listed = P.build(part.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("rec_idx"), F.split("p_name", " ")[0].alias("canonical"), F.array().cast("array<string>").alias("aliases"), F.lit(1.0).alias("score")), "word-set")
    lexicon = listed.select(F.lit("word-set").alias("kind"), F.lit("en").alias("locale"), "key", "value", "score", "ord")
    return L.contains_word(names, lexicon, "en", missing=missing).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def plugin_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lexicons of the part names; the later one wins, lists of candidates as a whole."""
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("key"), "p_size").groupBy("key").agg(F.max("p_size").alias("p_size"))
    first = _entries(names, "canonical-map", "en", "true", "upper(key)").union(_entries(names, "ranked-candidates", "en", "true", "key", "2.0")).union(_entries(names, "ranked-candidates", "en", "true", "upper(key)", "1.5", 1))
    later = _entries(names, "canonical-map", "en", "p_size > 25", "initcap(key)").union(_entries(names, "ranked-candidates", "en", "p_size > 25", "initcap(key)", "1.0"))
    return L.merge(first, later).select("kind", "locale", "key", "value", F.col("score").cast("double").alias("score"), F.col("ord").cast("long").alias("ord"))


def sources_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.sources_df(spark)


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" - ", "p_name", F.lower("p_type")).alias("text"))


def _spread_out(text: Column) -> Column:
    """Text with longer white space in it and around it."""
    return F.concat(F.lit(" \n"), F.regexp_replace(F.regexp_replace(text, "(?<=[a-f]) ", "  \t"), "(?<=[s-z]) ", " \n "), F.lit("\n\n"))


def separators(spark: SparkSession, sf_dir: str, style: SeparatorStyle) -> DataFrame:
    return _named(R.recase(_titles(spark, sf_dir), CaseOptions(mode=CaseMode.SENTENCE_TITLE, separators=style)))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as source records: aliases are the upper-case name and its first word."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("rec_idx"), F.initcap("p_name").alias("canonical"), F.array(F.upper("p_name"), F.initcap(F.split("p_name", " ")[0])).alias("aliases"), (1 + F.pmod("p_partkey", F.lit(5))).cast("float").alias("score"))


def built(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return P.build(_records(spark, sf_dir), kind).select("key", "value", F.col("score").cast("double").alias("score"), F.col("ord").cast("long").alias("ord"))


#: Names that fold in each way, under several records: (number, canonical form, aliases).
FOLDING = [
    (1, "Łódź", ["Lodz", "LODZ", "Lódź", "Boat"]), (2, "Straße des 17. Juni", ["Strasse des 17 Juni", "STRASSE", "strasse"]), (3, "Ærøskøbing", ["Aeroskobing", "Aeroeskoebing", "Aroskobing"]),
    (4, "Đakovo", ["Dakovo", "Djakovo", "dakovo"]), (5, "Œuvre", ["oeuvre", "Ouvre"]), (6, "Þingvellir", ["Thingvellir", "Pingvellir"]), (7, "Åland", ["Aaland", "Aland", "ÅLAND"]),
    (8, "Мой", ["Мои", "МОЙ"]), (9, "Mu\u0308nchen", ["Muenchen", "Munchen", "München", "Monaco"]), (10, "LODZ", ["Lodz"]), (11, "Monaco", ["MONACO", "Munich"]), (12, "ısparta", ["Isparta", "isparta"]),
]


def built_folding(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Lexicons of names whose letters have diacritics, with ties and keys of several records."""
    records = spark.createDataFrame([(n, c, a, float(n % 3 + 1)) for n, c, a in FOLDING], "rec_idx long, canonical string, aliases array<string>, score float")
    return P.build(records, kind).select("key", "value", F.col("score").cast("double").alias("score"), F.col("ord").cast("long").alias("ord"))


def parsed_sample(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    return samples.parse_sample(spark, source).select("canonical", F.array_join("aliases", "|").alias("aliases"), F.round(F.col("score").cast("double"), 4).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (flagship, token_counts_by_kind, token_offsets_checksum, reconstruct_roundtrip, rule_histogram, rule_histogram_all, checksum_text, sources_catalog)
}
QUERIES |= {f.__name__: f for f in (confidence_by_lang, analyzed, phrase_replace, german_aggressive, geonames_score, german_score, json_walk)}
QUERIES |= {
    "sentence_start_words": lambda spark, sf_dir: word_counts(spark, sf_dir, "starts", "lower"),
    "previous_words": lambda spark, sf_dir: word_counts(spark, sf_dir, "previous IS NOT NULL", "previous", "lower"),
    "edge_words": lambda spark, sf_dir: word_counts(spark, sf_dir, "edge", "lower"),
    "separator_flags": lambda spark, sf_dir: word_counts(spark, sf_dir, "after_separator", "lower", "starts"),
    "title_small_words": lambda spark, sf_dir: word_counts(spark, sf_dir, "rule = 'SmallWord'", "text", mode=CaseMode.TITLE),
    "title_case_part": partial(part_titles, mode=CaseMode.TITLE, text="concat(p_name, ': the ', p_type, ' of ', p_brand)"),
    "sentence_title": partial(part_titles, mode=CaseMode.SENTENCE_TITLE, text="concat(p_name, ' - ', p_type)"),
}
QUERIES |= {f"sentence_case_{x}": partial(recased, options=CaseOptions(locale=x)) for x in LANGS}
QUERIES |= {f"sentence_counts_{x}": partial(sentence_counts, lang=x) for x in LANGS}
QUERIES |= {
    "acronym_words": partial(words_of_class, of=C.acronym),
    "mixed_case_words": partial(words_of_class, of=C.mixed_case),
    "simple_capitalized_words": partial(words_of_class, of=C.simple_capitalized),
    "single_letter_words": partial(words_of_class, of=C.single_letter),
    "sentence_case_shouted": partial(recased, options=CaseOptions(), change=F.upper),
    "title_case_en": partial(recased, options=CaseOptions(mode=CaseMode.TITLE)),
    "german_balanced": partial(recased, options=CaseOptions(locale="de", german_mode=GermanMode.BALANCED), change=F.lower),
    "sentence_title_en": partial(recased, options=CaseOptions(mode=CaseMode.SENTENCE_TITLE)),
    "whitespace_collapse_flat": partial(recased, options=CaseOptions(mode=CaseMode.SENTENCE_TITLE), change=_spread_out),
    "whitespace_collapse_keep_lines": partial(recased, options=CaseOptions(), change=_spread_out),
    "spans_changed": partial(spans_changed, options=CaseOptions()),
    "spans_changed_title": partial(spans_changed, options=CaseOptions(locale="de", mode=CaseMode.SENTENCE_TITLE, separators=SeparatorStyle.SPACE_DASH_SPACE)),
    "canonical_lookup": partial(canonical_lookup, locale="en"),
    "lookup_priority": partial(canonical_lookup, locale="en-GB"),
    "word_set_semi": partial(word_set, missing=False),
    "word_set_anti": partial(word_set, missing=True),
    "plugin_merge_last_wins": plugin_merge,
    "separator_rewrite_colon": partial(separators, style=SeparatorStyle.COLON_SPACE),
    "separator_rewrite_dash": partial(separators, style=SeparatorStyle.SPACE_DASH_SPACE),
    "separator_rewrite_emdash": partial(separators, style=SeparatorStyle.EM_DASH_SPACE),
}
QUERIES |= {f"build_{k.replace('-', '_')}": partial(built, kind=k) for k in P.KINDS}
QUERIES |= {f"build_folding_{k.replace('-', '_')}": partial(built_folding, kind=k) for k in ("canonical-map", "ranked-candidates")}
QUERIES |= {f"source_{k.replace('-', '_')}": partial(parsed_sample, source=k) for k in samples.PARSERS}

_ALL = "SELECT doc_id AS key, text FROM documents"
_OF = {x: f"{_ALL} WHERE lang = '{x}'" for x in LANGS}
#: The same for every profile and for the rest; the case functions of Turkish, Azeri and Lithuanian aren't stated in SQL.
_LANGUAGE = "lower(split_part(replace(lang, '_', '-'), '-', 1))"
_OF_ALL = {x: f"{_ALL} WHERE {_LANGUAGE} = '{x}'" for x in PROFILES} | {NEUTRAL: f"{_ALL} WHERE coalesce({_LANGUAGE} NOT IN ({', '.join(map(repr, PROFILES))}), true)"}


def _class(test: str) -> str:
    return O.tokens(_ALL) + f" SELECT raw AS word, count(*) AS n FROM k WHERE kind = 'word' AND {test} GROUP BY raw"


def _title_sql(style: str) -> str:
    """Part titles have two lower-case halves of plain words around one separator."""
    cap = "upper(left({0}, 1)) || substr({0}, 2)"
    first, second = cap.format("lower(p_name)"), cap.format("lower(p_type)")
    return f"SELECT p_partkey AS doc_id, {first} || '{style}' || {second} AS output, 'Solid' AS confidence, len(string_split(p_name, ' ')) + len(string_split(p_type, ' ')) AS n_words FROM part"


#: Part names as records, and the (key, value) pairs that they and their aliases give; here a key has one value only.
_PAIRS = """WITH r AS (SELECT 1 + p_partkey % 5 AS score, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS c FROM part),
e AS (SELECT score, c AS v FROM r UNION ALL SELECT score, string_split(c, ' ')[1] FROM r)"""


def _built(value: str = "max(v)", score: str = "NULL::DOUBLE", where: str = "true") -> str:
    return f"{_PAIRS} SELECT lower(v) AS key, {value} AS value, {score} AS score, 0 AS ord FROM e WHERE {where} GROUP BY lower(v)"


_SPREAD = "SELECT doc_id AS key, chr(32) || chr(10) || regexp_replace(regexp_replace(text, '([a-f]) ', '\\1  ' || chr(9), 'g'), '([s-z]) ', '\\1 ' || chr(10) || ' ', 'g') || chr(10) || chr(10) AS text FROM documents WHERE lang = 'en'"
_ADDED = {x: f"SELECT doc_id AS key, text || '{ADDED.replace(chr(39), chr(39) * 2).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}' AS text FROM documents WHERE lang = '{x}'" for x in LANGS}


def _placed_sql(spans: str) -> str:
    sums = ", ".join(f"sum({c})::BIGINT AS sum_{c}" for c in ("src_start", "src_end", "out_start", "out_end"))
    return f"SELECT key AS doc_id, rule, confidence, count(*) AS n, count_if(changed) AS n_changed, {sums} FROM ({spans}) GROUP BY ALL"


def _met_sql(lang: str) -> str:
    return f"(SELECT DISTINCT low AS key FROM ({O.tokens(_OF[lang])} SELECT low FROM k WHERE kind = 'word'))"


def _priority(*locales: str) -> str:
    """Of each key the value of the first locale, protected forms before canonical ones."""
    tables = {
        ("en", 0): ("upper(left(key, 2)) || substr(key, 3)", "^[a-d][a-z]{6}$"), ("en", 1): ("upper(key)", "^[a-m][a-z]{6}$"), ("en-GB", 1): ("key || 'X'", "^[c-e][a-z]{6}$"),
    }
    rows = [f"SELECT key, {v} AS value, {2 * n + k} AS p FROM {_met_sql('en')} WHERE regexp_full_match(key, '{r.strip('^$')}')" for n, place in enumerate(locales) for k in (0, 1) if (place, k) in tables for v, r in [tables[place, k]]]
    return f"SELECT key, arg_min(value, p) AS value FROM ({' UNION ALL '.join(rows)}) GROUP BY key"


_ENDS = "min(key) FILTER (regexp_full_match(key, '[a-m][a-z]{2,4}')) AS a0, max(key) FILTER (regexp_full_match(key, '[a-m][a-z]{2,4}')) AS a1, min(key) FILTER (regexp_full_match(key, '[n-z][a-z]{1,3}')) AS b0, max(key) FILTER (regexp_full_match(key, '[n-z][a-z]{1,3}')) AS b1"
_PHRASES = f"SELECT DISTINCT key, upper(key) || '!' AS value FROM (SELECT unnest([a0 || ' ' || b0, a1 || ' ' || b1, 'and so', 'in the', 'it was']) AS key FROM (SELECT {_ENDS} FROM {_met_sql('en')}))"
#: Scores are 1 + 5 % 3 = 3 for the second candidate of all keys.
_BEST = f"SELECT key, key || 'a' AS value FROM {_met_sql('de')} WHERE regexp_full_match(key, '[a-z]{{5}}')"
_WORD_SET = "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) WHERE word {}IN (SELECT lower(string_split(p_name, ' ')[1]) FROM part WHERE p_size % 2 = 0) GROUP BY word"
_TITLED = "array_to_string(list_transform(string_split(key, ' '), lambda x: upper(x[1]) || x[2:]), ' ')"
_MERGED = f"""WITH n AS (SELECT lower(p_name) AS key, max(p_size) > 25 AS late FROM part GROUP BY lower(p_name))
SELECT 'canonical-map' AS kind, 'en' AS locale, key, CASE WHEN late THEN {_TITLED} ELSE upper(key) END AS value, NULL::DOUBLE AS score, 0::BIGINT AS ord FROM n
UNION ALL SELECT 'ranked-candidates', 'en', key, {_TITLED}, 1.0, 0 FROM n WHERE late UNION ALL SELECT 'ranked-candidates', 'en', key, key, 2.0, 0 FROM n WHERE NOT late
UNION ALL SELECT 'ranked-candidates', 'en', key, upper(key), 1.5, 1 FROM n WHERE NOT late"""

#: The pairs that FOLDING gives, stated in SQL: letters are folded by a list of replacements, spelled out or not.
_STRIP = "strip_accents(replace(replace(replace(replace({}, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'þ', 'th'))"
_FOLD = "translate(" + _STRIP.format("regexp_replace(lower(nfc_normalize({})), '[^\\p{{L}}\\p{{N}}]', '', 'g')") + ", 'đłøı', 'dloi')"
_SPELL = _FOLD.replace("lower(nfc_normalize({}))", "replace(replace(replace(replace(replace(lower(nfc_normalize({})), 'ä', 'ae'), 'ö', 'oe'), 'ø', 'oe'), 'ü', 'ue'), 'å', 'aa')")
_SAME = " OR ".join(f"{a.format('a')} = {b.format('c')}" for a in (_FOLD, _SPELL) for b in (_FOLD, _SPELL))
_FOLDED = (
    "WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, '{c}', [{', '.join(repr(x) for x in a)}], {n % 3 + 1}.0)" for n, c, a in FOLDING) + ") AS t(n, c, l, score)),\n"
    # й is a letter of its own, which stripping would change
    f"x AS (SELECT n, score, c, unnest(l) AS a FROM r), y AS (SELECT n, score, c, a, CASE WHEN c = 'Мой' THEN lower(a) = lower(c) ELSE {_SAME} END AS same FROM x),\n"
    "e AS (SELECT n, score, lower(c) AS key, c AS value FROM r UNION SELECT n, score, lower(a), CASE WHEN same THEN c ELSE a END FROM y WHERE same OR lower(a) <> a)\n"
)

ORACLE_SQL = {
    "build_folding_canonical_map": _FOLDED + "SELECT key, arg_max(value, (n, value)) AS value, NULL::DOUBLE AS score, 0 AS ord FROM e GROUP BY key",
    "build_folding_ranked_candidates": _FOLDED + "SELECT key, value, score::DOUBLE AS score, row_number() OVER (PARTITION BY key ORDER BY score DESC, value) - 1 AS ord FROM (SELECT DISTINCT key, value, score FROM e QUALIFY coalesce(lag(value) OVER (PARTITION BY key ORDER BY score DESC, value), '') <> value)",
    "flagship": " UNION ALL ".join(f"({O.output(_OF[x], x)})" for x in LANGS),
    "token_counts_by_kind": O.tokens(_ALL) + " SELECT kind, count(*) AS n FROM k GROUP BY kind",
    "token_offsets_checksum": O.tokens(_ALL) + ", e AS (SELECT key, sum(strlen(raw)) OVER (PARTITION BY key ORDER BY pos) AS src_end FROM k) SELECT key AS doc_id, count(*) AS n, sum(src_end) AS sum_end, max(src_end) AS n_bytes FROM e GROUP BY key",
    "reconstruct_roundtrip": f"SELECT count(*) AS n, count_if(array_to_string(regexp_extract_all(text, '{O.TOKEN}'), '') IS NOT DISTINCT FROM text) AS n_same, sum(len(regexp_extract_all(coalesce(text, ''), '{O.TOKEN}')))::BIGINT AS n_tokens FROM documents",
    "sentence_start_words": O.contexts(_ADDED["en"], "en") + " SELECT low AS lower, count(*) AS n FROM t WHERE starts GROUP BY low",
    "previous_words": O.contexts(_ADDED["en"], "en") + " SELECT pw AS previous, low AS lower, count(*) AS n FROM t WHERE kind = 'word' AND pw IS NOT NULL GROUP BY pw, low",
    "edge_words": O.contexts(_ADDED["en"], "en") + " SELECT low AS lower, count(*) AS n FROM t WHERE kind = 'word' AND pos IN (ew, lw) GROUP BY low",
    "separator_flags": O.contexts(_ADDED["en"], "en") + " SELECT low AS lower, starts, count(*) AS n FROM t WHERE kind = 'word' AND after_sep GROUP BY low, starts",
    "title_small_words": O.cascade(_ADDED["en"], "en", title=True) + " SELECT text, count(*) AS n FROM c WHERE rule = 'SmallWord' GROUP BY text",
    "title_case_part": O.output("SELECT p_partkey AS key, p_name || ': the ' || p_type || ' of ' || p_brand AS text FROM part", "en", title=True),
    "sentence_title": O.output("SELECT p_partkey AS key, p_name || ' - ' || p_type AS text FROM part", "en", subtitle=True),
    "geonames_score": """SELECT p_name AS canonical, CASE WHEN p_brand <> p_name THEN p_brand ELSE '' END AS aliases,
      round(CASE substr('PASLTH', 1 + p_size % 6, 1) WHEN 'P' THEN 3.0 WHEN 'A' THEN 2.6 WHEN 'S' THEN 2.2 WHEN 'L' THEN 1.8 WHEN 'T' THEN 1.8 ELSE 1.2 END
      + [1.0, 0.6, 0.6, 0.3, 0.0][1 + p_partkey % 5] + CASE WHEN p_size > 0 THEN log10(p_size * 1000) / 10 ELSE 0 END, 4)::DOUBLE AS score FROM part""",
    "german_score": """SELECT CASE WHEN p_partkey % 3 = 1 THEN p_type ELSE upper(left(p_name, 1)) || substr(p_name, 2) END AS canonical, CASE WHEN p_type = p_name THEN p_type ELSE p_type || '|' || p_name END AS aliases,
      round(CASE WHEN p_partkey % 3 = 1 THEN 3.0 ELSE 2.0 END + CASE WHEN p_size % 2 = 0 THEN 0.4 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0.1 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 0.1 ELSE 0 END
      + CASE WHEN p_size % 4 IN (0, 2) THEN 0.3 ELSE 0 END + CASE WHEN p_size % 7 = 0 THEN 0.5 ELSE 0 END, 4)::DOUBLE AS score FROM part WHERE p_partkey % 3 < 2""",
    "json_walk": "SELECT k.key AS k, count(*) AS n, count(DISTINCT k.value->>'$') AS n_values, min(k.value->>'$') AS low, max(k.value->>'$') AS high FROM events, json_each(props::JSON) k GROUP BY k.key",
    "confidence_by_lang": "SELECT lang, confidence, count(*) AS n, sum(n_words)::BIGINT AS n_words FROM (" + " UNION ALL ".join(f"(SELECT lang, confidence, n_words FROM ({O.output(_OF[x], x)}) JOIN documents USING (doc_id))" for x in LANGS) + ") GROUP BY lang, confidence",
    "sentence_title_en": O.output(_OF["en"], "en", subtitle=True),
    "whitespace_collapse_flat": O.output(_SPREAD, "en", subtitle=True),
    "whitespace_collapse_keep_lines": O.output(_SPREAD, "en"),
    "spans_changed": _placed_sql(O.spans(_ADDED["en"], "en")),
    "spans_changed_title": _placed_sql(O.spans(_ADDED["de"], "de", subtitle=True, separator=" - ")),
    "analyzed": f"SELECT o.doc_id, o.output, o.confidence, count(*) AS n_spans, count_if(changed) AS n_changed, sum(out_end)::BIGINT AS sum_out_end FROM ({O.output(_ADDED['en'], 'en')}) o JOIN ({O.spans(_ADDED['en'], 'en')}) s ON o.doc_id = s.key GROUP BY ALL",
    "canonical_lookup": O.output(_OF["en"], "en", lexicon=_priority("en")),
    "lookup_priority": O.output(_OF["en"], "en", lexicon=_priority("en-GB", "en")),
    "phrase_replace": O.output("SELECT doc_id AS key, text || ' The and  so in the big red it was, and; so' AS text FROM documents WHERE lang = 'en'", "en", phrases=_PHRASES),
    "german_aggressive": O.output("SELECT doc_id AS key, lower(text) AS text FROM documents WHERE lang = 'de'", "de", balanced=True, best=_BEST),
    "word_set_semi": _WORD_SET.format(""),
    "word_set_anti": _WORD_SET.format("NOT "),
    "plugin_merge_last_wins": _MERGED,
    "rule_histogram": O.cascade(_OF["en"], "en") + " SELECT rule, CASE WHEN rule IN ('AcronymPreserved', 'ProperNounPreserved') THEN 'Heuristic' ELSE 'Solid' END AS confidence, count(*) AS n, count(*) FILTER (raw <> text) AS n_changed, sum(strlen(text)) AS out_bytes FROM c WHERE kind = 'word' GROUP BY rule",
    "rule_histogram_all": "SELECT rule, CASE WHEN rule IN ('AcronymPreserved', 'ProperNounPreserved') THEN 'Heuristic' ELSE 'Solid' END AS confidence, count(*) AS n, count(*) FILTER (raw <> text) AS n_changed, sum(strlen(text)) AS out_bytes FROM ("
    + " UNION ALL ".join(f"({O.cascade(d, x)} SELECT rule, raw, text FROM c WHERE kind = 'word')" for x, d in _OF_ALL.items())
    + ") GROUP BY rule",
    "checksum_text": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "sources_catalog": registry.oracle_sql(),
    "acronym_words": _class(O.ACRONYM),
    "mixed_case_words": _class(O.MIXED),
    "simple_capitalized_words": _class(O.SIMPLE),
    "single_letter_words": _class(r"regexp_matches(raw, '^\p{L}$')"),
    "sentence_case_shouted": O.output("SELECT doc_id AS key, upper(replace(text, 'ß', 'ss')) AS text FROM documents WHERE lang = 'en'", "en"),
    "title_case_en": O.output(_OF["en"], "en", title=True),
    "german_balanced": O.output("SELECT doc_id AS key, lower(text) AS text FROM documents WHERE lang = 'de'", "de", balanced=True),
    "build_canonical_map": _built(),
    "build_multiword_map": _built(where="contains(v, ' ')"),
    "build_protected_forms": _built(where="v IN (SELECT c FROM r)"),
    "build_word_set": _built(value="NULL::VARCHAR"),
    "build_ranked_candidates": _built(score="max(score)::DOUBLE"),
    "separator_rewrite_colon": _title_sql(": "),
    "separator_rewrite_dash": _title_sql(" - "),
    "separator_rewrite_emdash": _title_sql(" — "),
    **{f"source_{k.replace('-', '_')}": sql for k, sql in SOURCE_SQL.items()},
    **{f"sentence_case_{x}": O.output(_OF[x], x) for x in LANGS},
    **{
        f"sentence_counts_{x}": O.contexts(_OF[x], x)
        + " SELECT key AS doc_id, count(*) FILTER (boundary) AS n_boundary, count(*) FILTER (starts) AS n_starts, max(sent) AS last_sentence, count(*) FILTER (shouting AND starts) AS n_shouting, count(*) FILTER (title_like AND starts) AS n_title_like FROM t GROUP BY key"
        for x in LANGS
    },
}
