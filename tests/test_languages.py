import duckdb

from versalia.functions.profiles import PROFILES
from versalia.plans import catalog

ROWS = [
    (1, "ALICE met Bob. dr. who and i", "en"), (2, "der Hund. die Katze", "de"), (3, "LE CHAT de Paris. oui", "fr"), (4, "la Casa. i vía", "es"),
    (5, "Dott. Rossi va a Roma. sì", "it"), (6, "no language. i see NASA", None), (7, "другой Язык. да", "ru"), (8, "Hello there. i am", "en-US"), (9, "An EMPTY code. x", ""),
]


def test_every_language_has_rows(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["output"] for r in catalog.flagship(spark, str(tmp_path)).collect()}
    assert sorted(got) == [r[0] for r in ROWS]
    assert got[5].startswith("Dott. Rossi va a") and got[6] == "No language. I see NASA" and got[8] == "Hello there. I am"
    rules = sorted(tuple(r) for r in catalog.rule_histogram_all(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rules == sorted(db.execute(catalog.ORACLE_SQL["rule_histogram_all"]).fetchall())
    assert sum(r[2] for r in rules) == sum(len(r[1].replace(".", "").split()) for r in ROWS)


def test_no_document_of_any_language(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert catalog.flagship(spark, str(tmp_path)).count() == 0 and catalog.NEUTRAL not in PROFILES
