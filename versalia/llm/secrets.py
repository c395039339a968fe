r"""Secret scans with corpus-wide ownership frequency, in built-in functions only.

Base spans are those of three fixed patterns. Beyond them, tokens that look generated are
candidates. Every span's and candidate's value is hashed; over the whole corpus, hashes are
counted by distinct repositories and distinct owners. A value that many owners hold, or several
in many repositories, is a copied example; one of a single owner is live-looking. Live-looking candidates become
spans of the kind ``token``; base spans always stay, and carry the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, joined_of, let, materialize, running, unboxed

#: Kinds in the order in which spans at the same start are listed: pattern, group of the value, fewest characters of the value.
KINDS = {
    "assign": (r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "token": (r"[A-Za-z0-9_-]+", 0, 20),
}
#: Runs of hex and token characters are mostly words; only runs that can be long enough are looked at.
#: Such runs are maximal, so a least length in the pattern finds the same ones.
SEARCHED = KINDS | {"access": (r"AKIA[A-Z0-9]{16,}", 0, 20), "hex": (r"[0-9a-f]{24,}", 0, 24), "token": (r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}", 0, 20)}
BASE = ("assign", "access", "hex")
ORDER = list(KINDS)
#: A value held by so many owners is a copied example; so is one of several owners in so many repositories.
COPIED_OWNERS = 3
COPIED_REPOSITORIES = 5
MASK = "[SECRET]"


def _generated(value: Column) -> Column:
    """Whether a run looks generated: letters of both cases and two digits; or, of one case, 8 different characters
    and four digits in a part of 13 letters and digits, which UUIDs and words and dates joined by hyphens don't have."""
    both = value.rlike("[0-9].*[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")
    one = value.rlike("[A-Za-z]") & value.rlike("(?<![A-Za-z0-9])(?=[A-Za-z0-9]{13})(?:[A-Za-z]*[0-9]){4}")
    return both | (one & (F.size(F.array_distinct(F.split(value, ""))) >= 8))


_SPANS = "cast(array() as array<struct<s:int,kind:int,e:int,value:string>>)"


def _found(text: Column, kind: str) -> Column:
    """Spans ``(s, kind, e, value)`` of a kind: leftmost non-overlapping matches, those with too short values dropped.

    The text is split at the matches; starts are running sums of the lengths of pieces and matches.
    """
    pattern, group, least = SEARCHED[kind]

    def spans(hits: Column, gaps: Column, before: Column) -> Column:
        def span(hit: Column, i: Column) -> Column:
            start = F.get(before, i) + F.get(gaps, i)
            return F.struct(start.alias("s"), F.lit(ORDER.index(kind)).alias("kind"), (start + F.length(hit)).alias("e"), F.regexp_extract(hit, pattern, group).alias("value"))

        good = lambda x: F.length(x["value"]) >= least
        if kind == "token":
            good = lambda x: (F.length(x["value"]) >= least) & _generated(x["value"])
        return F.filter(F.transform(hits, span), good)

    def placed(hits: Column) -> Column:
        # the last piece, after all matches, isn't paired
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        return let(gaps, lambda g: let(running(F.transform(hits, lambda h, i: F.get(g, i) + F.length(h)), lambda a, b: a + b), lambda before: spans(hits, g, before)))

    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    return let(hits, lambda h: F.when(F.size(h) == 0, F.expr(_SPANS)).otherwise(placed(h)))


def _outside(candidates: Column, spans: Column) -> Column:
    """The ``candidates`` that overlap none of ``spans``.

    Both are put in one order by start. What overlaps a candidate from before reaches beyond its start (running
    greatest end); what overlaps it from after is the next in the order, as candidates don't overlap each other.
    """
    token = ORDER.index("token")

    def free(both: Column) -> Column:
        ends = F.transform(both, lambda x: F.when(x["kind"] == token, 0).otherwise(x["e"]))

        def alone(x: Column, i: Column, before: Column) -> Column:
            after = F.get(both, i + 1)
            return (x["kind"] == token) & (F.get(before, i) <= x["s"]) & F.coalesce((after["kind"] == token) | (after["s"] >= x["e"]), F.lit(True))

        return let(running(ends, F.greatest), lambda before: F.filter(both, lambda x, i: alone(x, i, before)))

    merged = let(F.sort_array(F.concat(candidates, spans)), free)
    return F.when((F.size(candidates) == 0) | (F.size(spans) == 0), candidates).otherwise(merged)


def scan(docs: DataFrame, text: str = "text", repository: str = "source") -> DataFrame:
    """``(row_no, repo, spans, candidates, row)``: base spans and candidates as arrays of (s, kind, e, value); ``row`` has all columns of ``docs``.

    The owner of a repository ``owner/name`` is what stands before the slash. A null repository counts as one.
    """
    one = docs.select(boxed(docs), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"), F.coalesce(F.col(f"`{repository}`").cast("string"), F.lit("")).alias("repo"))
    found = one.select("row", "repo", *(_found(F.col("t"), k).alias(k) for k in KINDS)).select("row", "repo", "token", F.sort_array(F.concat(*BASE)).alias("spans"))
    return found.select(F.monotonically_increasing_id().alias("row_no"), "repo", "spans", _outside(F.col("token"), F.col("spans")).alias("candidates"), "row")


def ownership(scanned: DataFrame) -> DataFrame:
    """``(value_hash, repositories, owners)`` over the whole corpus.

    Distinct (value, owner, repository) are counted by owner, then by value, so that a value with very many
    copies is no hot group.
    """
    held = scanned.select("repo", F.explode(F.concat("spans", "candidates")).alias("x")).select(F.sha2("x.value", 256).alias("value_hash"), F.substring_index("repo", "/", 1).alias("owner"), "repo").distinct()
    owned = held.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return owned.groupBy("value_hash").agg(F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def copied() -> Column:
    """Whether a value's counts say that it is a copied example."""
    return (F.col("owners") >= COPIED_OWNERS) | ((F.col("owners") > 1) & (F.col("repositories") >= COPIED_REPOSITORIES))


def _judged(scanned: DataFrame, salts: int = 16) -> DataFrame:
    """``(row_no, all_spans, n_live, n_copied)`` for rows with a span or candidate."""
    told = ownership(scanned).select("value_hash", copied().alias("copied"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    each = scanned.select("row_no", F.explode(F.concat("spans", "candidates")).alias("x")).select("row_no", "x.s", "x.kind", "x.e", F.sha2("x.value", 256).alias("value_hash"), F.pmod("row_no", F.lit(salts)).cast("int").alias("salt"))
    kept = each.join(told, ["value_hash", "salt"]).filter((F.col("kind") < len(BASE)) | ~F.col("copied"))
    return kept.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("s", "kind", "e"))).alias("all_spans"), F.count_if(~F.col("copied")).alias("n_live"), F.count_if("copied").alias("n_copied"))


def _listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in ORDER))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied``.

    Null texts count as empty and have no span. Spans are ``kind:start:end`` in code points,
    end exclusive. Repeated rows give repeated results; ids may be null. An empty table gives an
    empty result. Other columns are not read.
    """
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{repository}`").alias("source"))
    scanned = materialize(scan(narrow).select("row_no", "repo", "spans", "candidates", F.col("row.doc_id").alias("doc_id")), "secrets")
    judged = _judged(scanned)
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == ORDER.index(k))).cast("long").alias(f"n_{k}")
    plain = scanned.select("row_no", "doc_id", *(n(k) for k in BASE), F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"))
    zero = F.lit(0).cast("long")
    return plain.join(judged, "row_no", "left").select(
        "doc_id", *(f"n_{k}" for k in BASE), "base_sha256", F.coalesce(_listed(F.col("all_spans")), F.lit("")).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"),
    )


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by the mask.

    Looking for a place in a text goes through it from its start, so blocks of spans are cut out first.
    """

    def whole(cuts: Column) -> Column:
        def block(part: Column) -> Column:
            start, end = F.get(part, F.lit(0))["at"], F.array_max(F.transform(part, lambda x: F.greatest(x["at"] + x["gap"], x["e"])))
            shown = lambda chunk: F.transform(
                F.filter(part, lambda x: x["gap"] >= 0), lambda x: F.concat(F.substring(chunk, x["at"] - start + 1, x["gap"]), F.lit(MASK))
            )
            return F.array_join(let(F.substring(text, start + 1, end - start), shown), "")

        return joined_of(cuts, block, lambda parts: F.concat(F.array_join(parts, ""), F.substring(text, F.array_max(F.transform(spans, lambda x: x["e"])) + 1, F.length(text))))

    def cut(before: Column) -> Column:
        return F.transform(spans, lambda x, i: F.struct(F.get(before, i).alias("at"), (x["s"] - F.get(before, i)).alias("gap"), x["e"].alias("e")))

    ends = F.transform(spans, lambda x: x["e"])
    return F.when(F.size(spans) == 0, text).otherwise(let(running(ends, F.greatest), lambda before: let(cut(before), whole)))


def mask_secrets(docs: DataFrame, text: str = "text", repository: str = "source") -> DataFrame:
    """``docs`` with every span of :func:`find_secrets` replaced by the mask; ``n_chars``, if there, follows.

    Null texts stay null, repeated rows stay repeated, an empty table gives an empty one; other columns pass through
    whatever their names. Only rows with a candidate beyond the base patterns wait for the ownership counts; they
    alone are written out with their texts, the others are scanned again.
    """
    scanned = scan(docs, text, repository)
    waits = F.size("candidates") > 0
    slim = materialize(scanned.select("row_no", "repo", "spans", "candidates", F.when(waits, F.col("row")).alias("row")), "secrets-mask")
    judged = _judged(slim.select("row_no", "repo", "spans", "candidates")).select("row_no", "all_spans")
    bare = "transform(spans, x -> struct(x.s as s, x.kind as kind, x.e as e))"
    # a row that waits may have lost all its candidates to the counts, and have no base span
    extra = slim.filter("row is not null").join(judged, "row_no", "left").select("row", F.coalesce("all_spans", F.expr(bare)).alias("spans"))
    both = scanned.filter(~waits).select("row", F.expr(bare).alias("spans")).unionByName(extra)
    out = both.select("row", _masked(F.col(f"row.`{text}`"), F.col("spans")).alias("masked"))
    changed = {text: F.col("masked")} | ({"n_chars": F.length("masked").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return unboxed(out, docs.columns, **changed)
