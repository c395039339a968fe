"""Recasing as one relational plan: generate tokens, windows per text, cascade, phrases, aggregate.

``recase`` does the same in one pass without a shuffle; this plan is what tests hold it against, and it joins
lexicons of any size. Keys must not repeat here (``recase`` sees to that). Null and empty texts give an empty output and
no span; an empty table an empty result; other columns are not read.

All windows partition by the key (or the key and a counter within it), so that one exchange by key
serves them. Running frames only: look-ahead goes by ``lead`` or by a running frame in
descending order, never by an unbounded following frame, which costs the square of a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import casing as C
from ..functions.profiles import BUILTIN_AMBIGUOUS, BUILTIN_FORMS, BUILTIN_PHRASES, GERMAN_AMBIGUOUS, GERMAN_ARTICLES, GERMAN_NOUN_ENDS, profile
from ..options import CaseMode, CaseOptions, GermanMode, SeparatorStyle
from . import lexicon as L
from .tokens import tokenize

WIDE_TERMINALS = list("。！？｡؟।॥")
TERMINALS = [*".!?…", *WIDE_TERMINALS]
SEPARATORS = list(":-–—")
CONFIDENCE = ["Solid", "Unverified", "Heuristic"]
RANK = {"AcronymPreserved": 2, "ProperNounPreserved": 2, "GermanNoun": 2, "Capitalized": 1}


def _in(word: Column, words) -> Column:
    return word.isin(*words) if words else F.lit(False)


def classes(tokens: DataFrame, language: str) -> DataFrame:
    """Tokens with the classes of words that later steps ask for, so that each pattern runs once and below the windows.

    Words that begin with a to z, or are lower-case ASCII throughout, need no pattern for most of them.
    """
    raw, word = F.col("raw"), F.col("kind") == "word"
    easy = F.left(raw, F.lit(1)).between("a", "z")
    t = tokens.withColumn("lower", F.when(word, C.lower(raw, language)))
    small = (F.octet_length(raw) == F.length(raw)) & (raw == F.lower(raw))
    return t.withColumns({
        "alpha": word & (easy | raw.rlike(r"\p{IsAlphabetic}")),
        "caps": word & ~easy & raw.rlike(r"\p{IsAlphabetic}") & ~raw.rlike(r"\p{IsLowercase}"),
        "up": word & ~small & raw.rlike(r"\p{IsUppercase}"),
        "starts_up": word & ~easy & raw.rlike(r"^\p{IsUppercase}"), "starts_num": word & ~easy & raw.rlike(r"^\p{N}"),
    })


def separable(table: dict[str, str]) -> bool:
    """Whether no phrase can begin inside another one, so that matches are found at each place by itself."""
    lists = [p.split(" ") for p in table]
    return not any(a[i : i + len(b)] == b[: len(a) - i] for a in lists for b in lists for i in range(1, len(a)))


def mark_phrases(t: DataFrame, table: dict[str, str]) -> DataFrame:
    """Adds ``phrase``, the form of the longest phrase of ``table`` that begins at a token, and ``start`` on all its tokens.

    ``table`` is a few literals and :func:`separable`; words are two tokens apart, with white space between.
    """
    by = Window.partitionBy("key").orderBy("pos")
    most = max(p.count(" ") for p in table)
    words = [F.col("lower"), *(F.lead(F.when(F.col("kind") == "word", F.col("lower")), 2 * k).over(by) for k in range(1, most + 1))]
    gaps = [F.lead("kind", 2 * k - 1).over(by) for k in range(1, most + 1)]
    t = t.withColumns({f"w{k}_": w for k, w in enumerate(words)} | {f"g{k}_": g for k, g in enumerate(gaps, 1)})
    found = F.lit(None).cast("struct<phrase:string,size:int>")
    for phrase in sorted(table, key=lambda p: p.count(" ")):
        parts = phrase.split(" ")
        same = F.col("w0_") == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.col(f"g{k}_") == "space") & (F.col(f"w{k}_") == part)
        found = F.when(same, F.struct(F.lit(table[phrase]).alias("phrase"), F.lit(2 * len(parts) - 1).alias("size"))).otherwise(found)
    t = t.withColumn("m_", found).drop(*(f"w{k}_" for k in range(most + 1)), *(f"g{k}_" for k in range(1, most + 1)))
    held = F.last(F.when(F.col("m_").isNotNull(), F.struct("pos", F.col("m_.size").alias("size"))), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("held_", held)
    start = F.when(F.col("pos") < F.col("held_.pos") + F.col("held_.size"), F.col("held_.pos"))
    return t.withColumn("start", start).withColumn("phrase", F.col("m_.phrase")).drop("m_", "held_")


def write_phrases(t: DataFrame, language: str) -> DataFrame:
    """Puts the phrases that :func:`mark_phrases` found in the place of their tokens."""
    hit = F.col("start").isNotNull()
    value = F.when(F.col("cap"), C.upper_first(F.col("phrase"), language)).otherwise(F.col("phrase"))
    text = F.when(hit, F.when(F.col("pos") == F.col("start"), value).otherwise("")).otherwise(F.col("text"))
    return t.withColumn("text", text).withColumn("rule", F.when(hit, "MultiwordLexicon").otherwise(F.col("rule")))


def contexts(tokens: DataFrame, options: CaseOptions) -> DataFrame:
    """Tokens with what the cascade needs: sentence, shouting, title_like, starts, separators, previous words, edges."""
    p, lang = profile(options.language), options.language
    key = Window.partitionBy("key")
    by, back = key.orderBy("pos"), key.orderBy(F.desc("pos"))
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, -1)
    word = F.col("kind") == "word"
    raw, kind = F.col("raw"), F.col("kind")
    t = classes(tokens, lang)
    ahead = F.when(word, F.when(F.col("starts_up"), 1).when(F.col("starts_num"), 2).otherwise(0))
    t = t.withColumn("ahead", F.last(ahead, ignorenulls=True).over(after))
    if options.preserve_known_proper_nouns and separable(BUILTIN_PHRASES):
        t = mark_phrases(t, BUILTIN_PHRASES)
    for n in (1, 2):
        t = t.withColumn(f"p{n}", F.lag(F.struct("raw", "kind", "lower"), n).over(by)).withColumn(f"n{n}", F.lead(F.struct("raw", "kind"), n).over(by))
    next_cap, next_digit = (F.coalesce(F.col("ahead") == n, F.lit(False)) for n in (1, 2))
    dot = raw == "."
    near = lambda c, v: F.coalesce(F.col(c)["raw"] == v, F.lit(False))
    of = lambda c, v: F.coalesce(F.col(c)["kind"] == v, F.lit(False))
    prev = F.col("p1")["lower"]
    stop = F.when(_in(prev, p.title), False).when(_in(prev, p.numeric), ~next_digit).when(_in(prev, p.trailing), next_cap).otherwise(~C.single_letter(F.col("p1")["raw"]))
    boundary = (
        F.when(~((kind == "punct") & raw.isin(*TERMINALS)), False).when(raw.isin(*WIDE_TERMINALS), True)
        .when((raw == "…") | (dot & (near("p1", ".") | near("n1", "."))), F.when(near("n1", "."), False).otherwise(next_cap))
        .when(dot & of("n1", "word"), False).when(dot & of("p1", "word"), stop).otherwise(True)
    )
    left = F.when(of("p1", "space"), F.col("p2")).otherwise(F.struct(F.col("p1")["raw"], F.col("p1")["kind"], F.col("p1")["lower"]))
    right = F.when(of("n1", "space"), F.col("n2")).otherwise(F.col("n1"))
    digits = lambda x: x.rlike("^[0-9]+$")
    ranged = (digits(left["raw"]) & digits(right["raw"])) | ((F.length(left["raw"]) == 1) & (F.length(right["raw"]) == 1))
    flanked = F.coalesce((left["kind"] == "word") & (right["kind"] == "word") & ~ranged, F.lit(False))
    spaced = of("p1", "space") & of("n1", "space")
    attached = (raw != "-") & of("p1", "word") & of("n1", "word")
    sep = F.coalesce((kind == "punct") & raw.isin(*SEPARATORS) & flanked & F.when(raw == ":", of("n1", "space")).otherwise(spaced | attached), F.lit(False))
    t = t.withColumn("boundary", F.coalesce(boundary, F.lit(False))).withColumn("sep", sep)
    count = lambda c: F.coalesce(F.sum(c.cast("int")).over(before), F.lit(0))
    t = t.withColumns({
        "sent": count(F.col("boundary")), "seps": count(F.col("sep")), "seg": count(kind.isin("punct", "symbol")) + F.coalesce(kind.isin("punct", "symbol").cast("int"), F.lit(0)),
        "sep_before": F.coalesce(F.lag("sep").over(by), F.lit(False)), "sep_after": F.coalesce(F.lead("sep").over(by), F.lit(False)),
        "first_word": F.min(F.when(word, F.col("pos"))).over(key), "last_word": F.max(F.when(word, F.col("pos"))).over(key),
        "first_mark": F.min(F.when(kind != "space", F.col("pos"))).over(key), "last_mark": F.max(F.when(kind != "space", F.col("pos"))).over(key),
    })
    sentence = Window.partitionBy("key", "sent")
    alpha, caps, upper = F.col("alpha"), F.col("caps"), F.col("up")
    small = _in(F.col("lower"), (*p.stop, *p.particles))
    long_caps = caps & (F.length(F.regexp_replace(raw, r"\P{IsAlphabetic}", "")) >= 5)
    any_of = lambda c: F.coalesce(F.max(F.when(alpha, c)).over(sentence), F.lit(False))
    all_of = lambda c: F.coalesce(F.min(F.when(alpha, c)).over(sentence), F.lit(True))
    t = t.withColumn("first_alpha", F.min(F.when(alpha, F.col("pos"))).over(sentence))
    rest = alpha & (F.col("pos") > F.col("first_alpha"))
    segment = Window.partitionBy("key", "seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumns({
        "small": small, "shouting": any_of(caps) & (all_of(caps) | (all_of(caps | small) & any_of(long_caps))),
        "title_like": F.coalesce(F.min(F.when(rest, upper | small)).over(sentence), F.lit(True)) & (F.sum((rest & upper).cast("int")).over(sentence) >= 2),
        "starts": word & (F.col("pos") == F.min(F.when(word, F.col("pos"))).over(sentence)),
        "after_sep": word & (F.col("seps") > F.coalesce(F.last(F.when(word, F.col("seps")), ignorenulls=True).over(before), F.lit(0))),
        "prev_word": F.last(F.when(word, F.col("lower")), ignorenulls=True).over(segment),
        "edge": word & ((F.col("pos") == F.col("first_word")) | (F.col("pos") == F.col("last_word"))),
    })


def cascade(t: DataFrame, options: CaseOptions, lexicon: DataFrame | None) -> DataFrame:
    """Adds ``text`` and ``rule``: the decision for every word, the normal form of white space and separators."""
    p, lang, mode = profile(options.language), options.language, options.mode
    title = mode is CaseMode.TITLE
    raw, low = F.col("raw"), F.col("lower")
    user = best = F.lit(None).cast("string")
    if lexicon is not None:
        t = t.join(L.canonical(lexicon, options.locale), t["lower"] == F.col("lex_key"), "left").drop("lex_key")
        user = F.col("lex_value")
        if lang == "de" and options.german_mode is GermanMode.AGGRESSIVE:
            t = t.join(L.best_candidates(lexicon, "de"), t["lower"] == F.col("cand_key"), "left").drop("cand_key")
            best = F.col("cand_value")
    subtitle = F.col("after_sep") if options.capitalize_after_subtitle and mode is not CaseMode.SENTENCE else F.lit(False)
    cap = F.col("starts") | subtitle
    plain = ~F.col("shouting") & ~F.col("title_like")
    signal = F.lit(True) if title else (raw != low) & plain
    forms = F.lit(None).cast("string")
    for k, v in BUILTIN_FORMS.items():
        forms = F.when(low == k, F.lit(v)).otherwise(forms)
    known = F.coalesce(user, F.when(~low.isin(*BUILTIN_AMBIGUOUS) | signal, forms))
    one = lambda text, rule: F.struct(text.alias("text"), F.lit(rule).alias("rule"))
    chain = F
    rules: list[tuple[Column, Column]] = []
    if options.preserve_known_proper_nouns:
        rules.append((known.isNotNull(), one(known, "CanonicalLexicon")))
    if options.preserve_acronyms:
        rules.append((F.col("up") & ~F.col("shouting") & C.acronym(raw), one(raw, "AcronymPreserved")))
    if options.preserve_mixed_case:
        rules.append((F.col("up") & C.mixed_case(raw), one(raw, "MixedCasePreserved")))
    if options.preserve_existing_capitals and not title:
        rules.append((F.col("up") & ~cap & plain & C.simple_capitalized(raw), one(raw, "ProperNounPreserved")))
    if lang == "de" and options.german_mode >= GermanMode.BALANCED:
        noun = ~low.isin(*GERMAN_AMBIGUOUS) & (F.octet_length(low) > 2) & (low.rlike(f"({'|'.join(GERMAN_NOUN_ENDS)})$") | F.coalesce(F.col("prev_word").isin(*GERMAN_ARTICLES), F.lit(False)))
        german = F.coalesce(best, F.when(noun, C.capitalize(raw, lang)))
        lift = (cap | F.col("edge")) if title else cap
        rules.append((german.isNotNull(), one(F.when(lift, C.upper_first(german, lang)).otherwise(german), "GermanNoun")))
    if title:
        shown = C.titlecase(raw, lang, p)
        rules += [
            (cap, one(C.upper_first(shown, lang), "SentenceStart")), (F.col("edge"), one(C.upper_first(shown, lang), "TitleEdge")),
            (~F.col("small"), one(shown, "Capitalized")), (F.lit(True), one(low, "SmallWord")),
        ]
    else:
        rules.append((cap, one(C.capitalize(raw, lang), "SentenceStart")))
        if lang == "en":
            rules.append((F.translate(low, "’", "'").isin("i", "i'm", "i'll", "i've", "i'd"), one(C.capitalize(raw, lang), "AlwaysCapitalized")))
        rules.append((F.lit(True), one(low, "Lowercased")))
    for when, then in rules:
        chain = chain.when(when, then)
    rewrite = options.separators is not SeparatorStyle.PRESERVE
    space = raw
    if options.normalize_whitespace:
        outside = (F.col("pos") < F.coalesce("first_mark", F.lit(1 << 30))) | (F.col("pos") > F.col("last_mark"))
        inner = F.lit(" ") if mode.flattens_lines else F.when(raw.contains("\n"), "\n").otherwise(" ")
        space = F.when(outside, "").otherwise(inner)
    if rewrite:
        space = F.when(F.col("sep_before") | F.col("sep_after"), "").otherwise(space)
    mark = F.when(F.col("sep"), options.separators.value).otherwise(raw) if rewrite else raw
    other = F.struct(F.when(F.col("kind") == "space", space).otherwise(mark).alias("text"), F.when((F.col("kind") == "space") & (space != raw), "WhitespaceCollapsed").when(F.col("sep") & F.lit(rewrite), "SubtitleSeparator").alias("rule"))
    decided = t.withColumn("cap", cap).withColumn("d", F.when(F.col("kind") == "word", chain).otherwise(other))
    return decided.select("*", "d.text", "d.rule").drop("d")


def phrases(t: DataFrame, options: CaseOptions, lexicon: DataFrame | None) -> DataFrame:
    """Known phrases of 4, 3 or 2 words within a segment, longest first, from left to right, written over their tokens."""
    lang = options.language
    words = t.filter(F.col("kind") == "word")
    seg = Window.partitionBy("key", "seg").orderBy("pos")
    # only white space may lie between: words of a segment that are two tokens apart each
    nth = [F.lead(F.struct(C.lower(F.col("text"), lang).alias("w"), F.col("pos").alias("at")), k).over(seg) for k in (1, 2, 3)]
    grams = words.select("key", "pos", "cap", F.array(F.struct(C.lower(F.col("text"), lang).alias("w"), F.col("pos").alias("at")), *nth).alias("ws"))
    starts = grams.select("key", "pos", "cap", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.array_join(F.transform(F.slice("ws", 1, n), lambda x: x["w"]), " ").alias("phrase"), F.col("ws")[n - 1]["at"].alias("end")) for n in (4, 3, 2)))).alias("g")).select("key", "pos", "cap", "g.*").filter("end is not null")
    table = t.sparkSession.createDataFrame([(k, v, 1) for k, v in BUILTIN_PHRASES.items()], "phrase string, value string, prio int")
    if lexicon is not None:
        table = table.union(L.phrase_table(lexicon, options.locale).withColumn("prio", F.lit(0))).groupBy("phrase").agg(F.min_by("value", "prio").alias("value"))
    found = starts.join(table.select("phrase", "value"), "phrase")
    ordered = F.sort_array(F.collect_list(F.struct("pos", (-F.col("n")).alias("n"), "end", "value", "cap")))
    fold = F.aggregate(
        ordered, F.expr("struct(-1 as e, cast(array() as array<struct<pos:int,n:int,end:int,value:string,cap:boolean>>) as k)"),
        lambda a, x: F.when(x["pos"] > a["e"], F.struct(x["end"].alias("e"), F.array_append(a["k"], x).alias("k"))).otherwise(a), lambda a: a["k"],
    )
    kept = found.groupBy("key").agg(fold.alias("k")).select("key", F.explode("k").alias("x"))
    value = F.when(F.col("x.cap"), C.upper_first(F.col("x.value"), lang)).otherwise(F.col("x.value"))
    written = kept.select("key", F.col("x.pos").alias("start"), value.alias("value"), F.explode(F.sequence("x.pos", "x.end")).alias("pos"))
    joined = t.join(written, ["key", "pos"], "left")
    hit = F.col("start").isNotNull()
    return joined.withColumn("text", F.when(hit, F.when(F.col("pos") == F.col("start"), F.col("value")).otherwise("")).otherwise(F.col("text"))).withColumn("rule", F.when(hit, "MultiwordLexicon").otherwise(F.col("rule"))).drop("value")


def decided_tokens(docs: DataFrame, options: CaseOptions, key: str, text: str, lexicon: DataFrame | None = None) -> DataFrame:
    """The tokens of each text with what they become. Without a lexicon, known phrases are literals and need no join."""
    t = cascade(contexts(tokenize(docs, key, text, outer=True), options), options, lexicon)
    if not options.preserve_known_proper_nouns:
        return t.withColumn("start", F.lit(None).cast("int"))
    if lexicon is None and separable(BUILTIN_PHRASES):
        return write_phrases(t, options.language)
    return phrases(t.drop("start", "phrase"), options, lexicon)


def spans(docs: DataFrame, options: CaseOptions = CaseOptions(), key: str = "doc_id", text: str = "text", lexicon: DataFrame | None = None) -> DataFrame:
    """``(key, src_start, src_end, out_start, out_end, rule, confidence, changed)``: UTF-8 byte ranges of every decision.

    Words always have a span; a phrase and a rewritten separator with the spaces around it are one;
    white space has one only where it changed.
    """
    t = decided_tokens(docs, options, key, text, lexicon).filter(F.col("pos").isNotNull())
    run = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"src_end": F.sum(F.octet_length("raw")).over(run), "out_end": F.sum(F.octet_length("text")).over(run)})
    rewrite = options.separators is not SeparatorStyle.PRESERVE
    group = F.coalesce("start", F.col("pos"))
    if rewrite:
        space = F.col("kind") == "space"
        group = F.when(space & F.col("sep_after"), F.col("pos") + 1).when(space & F.col("sep_before"), F.col("pos") - 1).otherwise(group)
        t = t.withColumn("rule", F.when(space & (F.col("sep_after") | F.col("sep_before")), "SubtitleSeparator").otherwise(F.col("rule")))
    part = F.struct("pos", "raw", "text")
    joined = lambda f: F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x[f]), "")
    merged = t.filter("rule is not null").groupBy("key", group.alias("g")).agg(
        F.min(F.col("src_end") - F.octet_length("raw")).alias("src_start"), F.max("src_end").alias("src_end"),
        F.min(F.col("out_end") - F.octet_length("text")).alias("out_start"), F.max("out_end").alias("out_end"),
        F.max("rule").alias("rule"), (joined("raw") != joined("text")).alias("changed"),
    )
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))[F.col("rule")], F.lit(0))
    shown = merged.filter((F.col("rule") != "SubtitleSeparator") | F.col("changed"))
    return shown.select("key", "src_start", "src_end", "out_start", "out_end", "rule", F.element_at(F.array(*map(F.lit, CONFIDENCE)), rank + 1).alias("confidence"), "changed")


def recase(docs: DataFrame, options: CaseOptions = CaseOptions(), key: str = "doc_id", text: str = "text", lexicon: DataFrame | None = None) -> DataFrame:
    """``(key, output, confidence, n_words)``: one row per distinct key, which must not repeat.

    Null and empty texts give an empty output and are Solid.
    """
    t = decided_tokens(docs, options, key, text, lexicon)
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))[F.col("rule")], F.lit(0))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: F.coalesce(x["text"], F.lit("")))
    out = t.groupBy("key").agg(F.array_join(ordered, "").alias("output"), F.max(rank).alias("r"), F.count_if(F.col("kind") == "word").alias("n_words"))
    return out.select("key", "output", F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.col("r") + 1).alias("confidence"), "n_words")


def sentence_case(docs: DataFrame, locale: str, **names) -> DataFrame:
    return recase(docs, CaseOptions(locale=locale), **names)


def sentence_case_title(docs: DataFrame, locale: str, **names) -> DataFrame:
    return recase(docs, CaseOptions(locale=locale, mode=CaseMode.SENTENCE_TITLE), **names)
