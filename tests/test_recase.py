import pickle
import random
import weakref
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from tests.golden import CASES
from versalia.operators import lexicon as L
from versalia.functions import words as W
from versalia.functions.profiles import profile
from versalia.operators import recase as R
from versalia.operators import relational
from versalia.operators.recase import recase, spans
from versalia.operators.relational import separable
from versalia.operators.tokens import reconstruct, tokenize
from versalia.options import CaseMode, CaseOptions, GermanMode, SeparatorStyle
from versalia.plans import plugins
from versalia.sources import samples
from versalia.sources.registry import LexiconError, require


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)


@pytest.mark.parametrize("plan", [recase, relational.recase])
def test_golden_cases(spark, plan):
    groups = defaultdict(list)
    for options, lexicon, given, wanted in CASES:
        groups[options, str(lexicon)].append((lexicon, given, wanted))
    for (options, _), cases in groups.items():
        lexicon = spark.createDataFrame(cases[0][0], L.SCHEMA) if cases[0][0] else None
        got = {r["key"]: r["output"] for r in plan(_docs(spark, [c[1] for c in cases]), options, lexicon=lexicon).collect()}
        assert [got[k] for k in range(len(cases))] == [c[2] for c in cases]


def test_empty_and_null_texts(spark):
    rows = {r["key"]: r for r in recase(_docs(spark, ["", None, "  \n ", "a"]), CaseOptions()).collect()}
    assert [rows[k]["output"] for k in range(4)] == ["", "", "", "A"]
    assert rows[0]["confidence"] == "Solid"
    assert recase(_docs(spark, ["a"]).limit(0), CaseOptions()).count() == 0


def test_tokens_round_trip(spark):
    texts = ["don't stop — 3.5 km…\n\n “Ünïcode”‑x", "a-b -- c'd' e", "   "]
    got = {r["key"]: r["output"] for r in reconstruct(tokenize(_docs(spark, texts), "doc_id", "text"), "raw").collect()}
    assert [got[k] for k in range(3)] == texts


def test_spans(spark):
    s = spans(_docs(spark, ["alice   met bob in new york"]), CaseOptions()).collect()
    by = {(r["src_start"], r["src_end"]): r for r in s}
    assert by[5, 8]["rule"] == "WhitespaceCollapsed" and by[5, 8]["changed"]
    assert by[8, 11]["rule"] == "Lowercased" and not by[8, 11]["changed"]
    assert by[19, 27]["rule"] == "MultiwordLexicon" and by[19, 27]["changed"]
    t = spans(_docs(spark, ["the album - remastered"]), CaseOptions(mode=CaseMode.SENTENCE_TITLE, separators=SeparatorStyle.COLON_SPACE)).filter("rule = 'SubtitleSeparator'").first()
    assert (t["src_start"], t["src_end"], t["changed"]) == (9, 12, True)


@pytest.mark.parametrize("source", sorted(samples.PARSERS))
def test_samples_parse(spark, source):
    rows = samples.parse_sample(spark, source).collect()
    assert rows and all(r["canonical"] and r["score"] > 0 for r in rows)


def test_gate_and_plugins(spark, tmp_path):
    with pytest.raises(LexiconError, match="acknowledge-cc-by-sa"):
        require("ud-german-gsd")
    with pytest.raises(LexiconError, match="support"):
        require("wikidata", "word-set")
    records = samples.parse_sample(spark, "musicbrainz").selectExpr("monotonically_increasing_id() rec_idx", "*")
    made = plugins.prepare(records, "musicbrainz", "canonical-map", "en")
    document = plugins.write_json_plugin(made, str(tmp_path / "p.json"), "m", "canonical-map", "en")
    assert document["payload"]["asa lindqvist"] == "Åsa Lindqvist"
    back = plugins.read_json_plugin(spark, str(tmp_path / "p.json"))
    plugins.write_table_plugin(back, str(tmp_path / "t"))
    assert {tuple(r)[:4] for r in plugins.read_table_plugin(spark, str(tmp_path / "t")).collect()} == {tuple(r)[:4] for r in made.collect()}
    assert recase(_docs(spark, ["odo saw harpist asa"]), CaseOptions(), lexicon=back).first()["output"] == "Odo saw harpist asa"


def test_merge_last_wins(spark):
    a = spark.createDataFrame([("canonical-map", "en", "x", "X", None, 0), ("canonical-map", "en", "y", "Y", None, 0)], L.SCHEMA)
    b = spark.createDataFrame([("canonical-map", "en", "x", "xX", None, 0)], L.SCHEMA)
    assert {r["key"]: r["value"] for r in L.merge(a, b).collect()} == {"x": "xX", "y": "Y"}


def test_entry_points(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert entry.entry(spark).count() == 200


def random_texts(seed, n=300):
    rng = random.Random(seed)
    bits = "the a Of and new York NEW york San Francisco van der waals Rust rust GITHUB iphone NASA McDonald don't i i'm l'homme d'affaires o'brien jean-paul heute die wissenschaft Freiheit haus dr. Mr. no. 5 12 3 - – — : , ; ! ? … ... . etc. usw. inc. 。 ？ x y é Ünï ß ßa straße \n \t I A THE GREAT ALBUM ijssel istanbul İzmir e.g. 3.5 re:invent “quote” (paren) <tag> & * 你好 ½ naïve".split(" ")
    return [None, "", " \n ", "a"] + ["".join(rng.choice(bits) + rng.choice([" ", " ", " ", "  ", "\n", ""]) for _ in range(rng.randint(1, 40))) for _ in range(n)]


LEXICON = [
    ("canonical-map", "en", "nasa", "Nasa", None, 0), ("protected-forms", "en", "x", "xX", None, 0), ("multiword-map", "en", "the a", "The-A Thing", None, 0), ("multiword-map", "de", "die freiheit", "DIE Freiheit", None, 0),
    ("ranked-candidates", "de", "haus", "HausX", 2.0, 0), ("canonical-map", "de", "usw", "USW", None, 0),
]
FIELDS = ("key", "src_start", "src_end", "out_start", "out_end", "rule", "confidence", "changed")


@pytest.mark.parametrize(
    "options,lexicon",
    [
        (CaseOptions(), False), (CaseOptions(mode=CaseMode.TITLE), False), (CaseOptions(mode=CaseMode.SENTENCE_TITLE, separators=SeparatorStyle.COLON_SPACE), True),
        (CaseOptions(locale="de", german_mode=GermanMode.AGGRESSIVE, mode=CaseMode.TITLE, separators=SeparatorStyle.EM_DASH_SPACE), True), (CaseOptions(locale="fr", mode=CaseMode.TITLE), False), (CaseOptions(locale="tr"), True),
        (CaseOptions(preserve_known_proper_nouns=False, preserve_acronyms=False, preserve_mixed_case=False, preserve_existing_capitals=False, normalize_whitespace=False), False),
    ],
)
def test_one_pass_agrees_with_joins_and_windows(spark, options, lexicon):
    docs = _docs(spark, random_texts(str(options))).repartition(2)
    words = spark.createDataFrame(LEXICON, L.SCHEMA) if lexicon else None
    a, b = ({r["key"]: tuple(r) for r in plan(docs, options, lexicon=words).collect()} for plan in (recase, relational.recase))
    assert a == b
    a, b = (sorted(tuple(r[f] for f in FIELDS) for r in plan(docs, options, lexicon=words).collect()) for plan in (spans, relational.spans))
    assert a == b
    told = {r["key"]: r for r in R.analyze(docs, options, lexicon=words).collect()}
    assert sorted((k, *s) for k, r in told.items() for s in r["spans"]) == a
    assert all([s["src_start"] for s in r["spans"]] == sorted(s["src_start"] for s in r["spans"]) for r in told.values())


def test_lexicons_too_large_to_send(spark, monkeypatch):
    docs, words = _docs(spark, random_texts(5, 60)), spark.createDataFrame(LEXICON + [("canonical-map", "en", f"never{k}", "N", None, 0) for k in range(50)], L.SCHEMA)
    want = sorted(tuple(r) for r in recase(docs, lexicon=words).collect())
    seen = []
    monkeypatch.setattr(R, "met_words", lambda *a, of=R.met_words: seen.append(1) or of(*a))
    for rows in (10, 1):  # cut to the words that occur; joined
        monkeypatch.setattr(R, "SENT_ROWS", rows)
        assert sorted(tuple(r) for r in recase(docs, lexicon=words).collect()) == want
        assert sorted(tuple(r[f] for f in FIELDS) for r in spans(docs, lexicon=words).collect()) == sorted(tuple(r[f] for f in FIELDS) for r in relational.spans(docs, lexicon=words).collect())
        assert {r["key"]: len(r["spans"]) for r in R.analyze(docs, lexicon=words).collect()}[1] == 0
    assert len(seen) == 6


def test_repeated_and_null_keys_stay_apart(spark, monkeypatch):
    rows = [(1, "ANOTHER text here"), (1, "hello world"), (None, "third one"), (None, "fourth one"), (2, None)]
    docs, words = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(LEXICON, L.SCHEMA)
    want = sorted([(1, "ANOTHER text here"), (1, "Hello world"), (None, "Third one"), (None, "Fourth one"), (2, "")], key=str)
    assert sorted(((r["key"], r["output"]) for r in recase(docs).collect()), key=str) == want
    monkeypatch.setattr(R, "SENT_ROWS", 0)
    assert sorted(((r["key"], r["output"]) for r in recase(docs, lexicon=words).collect()), key=str) == want
    crowded = docs.selectExpr("*", "'x' AS key", "'x' AS language", "'x' AS output")
    assert recase(crowded).columns == ["key", "output", "confidence", "n_words"] and spans(crowded.limit(0)).count() == 0


def test_no_exchange_for_inputs_of_enough_splits(spark):
    docs = spark.range(100, numPartitions=8).selectExpr("id AS doc_id", "'some text' AS text")
    plan = recase(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_tables_of_all_languages_are_bounded_together(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(R, "REMEMBERED", 60)
    batches = [pa.RecordBatch.from_pydict({"text": [" ".join(f"w{n}x{k}" for k in range(10)) for _ in R.RULES[:4]], "language": ["en", "de", "fr", "es"]}) for n in range(20)]
    alive, sizes = weakref.WeakSet(), []

    class Seen(R.Table):
        __hash__ = object.__hash__

        def __init__(self, *given):
            super().__init__(*given)
            alive.add(self)

    monkeypatch.setattr(R, "Table", Seen)
    monkeypatch.setattr(R, "few_splits", lambda docs: type("Kept", (), {"mapInArrow": staticmethod(lambda run, schema: run)}))
    run = R._each(spark.range(1), "text", "language", CaseOptions(), R.NO_WORDS, "", lambda batch, rows, table, d: R.written(table, d))
    for texts in run(iter(batches)):
        assert texts[0].startswith("W")
        sizes.append(sum(map(len, alive)))
    assert len(sizes) == 80 and max(sizes) <= 60 + 2 * 11


def test_lexicons_are_held_once_and_small(spark):
    words = {f"word{k}": f"Word{k}" for k in range(20_000)}
    sent = R.Dictionary(words, {"word1 word2": "Word 1-2"}, {})
    tables = [R.Table(CaseOptions(locale=x), sent) for x in ("en", "fr", "es")]
    assert all(len(t.listed) < 2000 for t in tables)
    assert len(pickle.dumps(sent)) < 900_000
    table = tables[0]
    find = R.token_finder()
    texts = ["so word7 met word1 word2 and new york", "word20000"]
    d = R.decide(table, [[table[x] for x in find(t)] for t in texts])
    assert R.written(table, d) == ["So Word7 met Word 1-2 and New York", "Word20000"]


def test_workers_get_few_rows_at_once(spark):
    name, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", _docs(spark, ["a b"])
    before = spark.conf.get(name)
    try:
        for told, held in (("10000", "1000"), ("0", "1000"), ("7", "7")):
            spark.conf.set(name, told)
            assert recase(docs).count() == 1 and spark.conf.get(name) == held
    finally:
        spark.conf.set(name, before)


def test_tokens_of_latin_texts():
    import regex

    everywhere = regex.compile(r"(?s)\p{White_Space}+|[\p{Alphabetic}\p{N}]+(?:['’\-‐‑][\p{Alphabetic}\p{N}]+)*|.")
    rng, find = random.Random(3), R.token_finder()
    alphabet = [chr(c) for c in range(256)]
    for _ in range(300):
        text = "".join(rng.choice(alphabet if rng.random() < 0.5 else "ab'- ") for _ in range(60))
        assert find(text) == everywhere.findall(text)


def test_words_of_languages():
    assert W.lower("JÌ ĮĮ̀", "lt") == "ji̇̀ įį̇̀" and W.upper("i̇̀", "lt") == "Ì".replace("Ì", "I" + "̀") and W.capitalize("JÌ", "lt") == "Ji̇̀"
    assert W.upper_first("ήλιος", "el")[0] == "Η" and W.upper_first("ήλιος", "en")[0] == "Ή" and W.upper_first("e\u0301té", "fr") == "E\u0301té"
    assert W.capitalize("ßa", "de") == "Ssa" and W.capitalize("ijs", "nl") == "IJs" and W.lower("IİI\u0307", "tr") == "ıii"
    assert W.titlecase("d'l'homme-o'neil", "fr", profile("fr")) == "d'l'Homme-O'Neil" and W.titlecase("o'clock", "en", profile("en")) == "O'clock"


def test_streams_are_recased_without_state(spark, tmp_path):
    spark.createDataFrame([(1, "hello WORLD. bye")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    query = recase(stream).writeStream.format("memory").queryName("recased").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r["output"] for r in spark.table("recased").collect()] == ["Hello WORLD. Bye"]


def test_phrases_found_as_literals_and_by_join_agree(spark):
    texts = ["we saw NEW york and san francisco.", "van der waals, new\nyork", "new york new york van der  waals", "new, york; san-francisco new", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = spark.createDataFrame([], L.SCHEMA)
    fields = ("key", "src_start", "src_end", "out_start", "out_end", "rule", "confidence", "changed")
    marked, joined = (sorted(tuple(r[f] for f in fields) for r in relational.spans(docs, lexicon=x).collect()) for x in (None, none))
    assert marked == joined
    assert sum(r[5] == "MultiwordLexicon" for r in marked) == 7


def test_phrases_that_can_begin_inside_others_are_not_separable():
    assert separable({"new york": "", "new york city": "", "van der waals": ""})
    assert not separable({"new york": "", "york city": ""})
    assert not separable({"a new york": "", "new york": ""})
    assert not separable({"a a": ""})
