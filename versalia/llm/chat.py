r"""Chat formatting by prefix-target expansion: one example per assistant turn.

An example is the text of all turns up to and including one assistant turn, with a loss mask
over that reply's text alone. A conversation that doesn't end with an assistant turn gets one
more example, of all its turns and with an empty mask, so that no turn is lost.

Template of a turn: ``### role: text</turn>\n``. In texts and roles a backslash goes before
each backslash, each ``#`` and each ``/`` after ``<`` (in roles also before ``:``), so neither
``###`` nor ``</turn>`` occurs in them and taking the backslashes away gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

OPEN, CLOSE, TRAINED = "### ", "</turn>\n", "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"[\\#]|(?<=<)/", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Examples ``(conv_id, example, last, formatted, loss_start, loss_end)``.

    ``loss_start`` and ``loss_end`` are code points of ``formatted``, end exclusive; equal where
    nothing is trained. ``last`` marks the example that holds the whole conversation. Turns go
    by ``turn``, ties by role, then text; nulls come first. Null roles and texts count as
    empty; repeated rows are turns of their own; rows with a null id form one conversation.
    An empty table gives no example. Other columns are not read.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), F.regexp_replace(escape(t["role"]), ":", r"\\:"), F.lit(": "))
    parts = whole.select(
        "conv_id",
        F.transform("turns", lambda t: let(F.struct(head(t).alias("h"), escape(t["text"]).alias("x")), lambda s: F.struct((t["role"] == TRAINED).alias("trained"), F.length(s["x"]).alias("n"), F.concat(s["h"], s["x"], F.lit(CLOSE)).alias("turn")))).alias("parts"),
    )
    size = F.size("parts")
    ends = F.filter(F.sequence(F.lit(1), size), lambda i: F.get(F.col("parts"), i - 1)["trained"] | (i == size))
    example = parts.withColumn("ends", ends).select("conv_id", "parts", F.posexplode("ends").alias("example", "n_turns"))
    shown = example.select(
        "conv_id", "example", (F.col("n_turns") == size).alias("last"), F.get(F.col("parts"), F.col("n_turns") - 1).alias("target"),
        F.array_join(F.transform(F.slice("parts", 1, F.col("n_turns")), lambda p: p["turn"]), "").alias("formatted"),
    )
    end = F.length("formatted") - len(CLOSE)
    return shown.select("conv_id", "example", "last", "formatted", F.when(F.col("target.trained"), end - F.col("target.n")).otherwise(end).alias("loss_start"), end.alias("loss_end"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pieces = F.split(formatted, CLOSE)
    pattern = r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+): (.*)$"
    return F.transform(
        F.filter(pieces, lambda p: p != ""),
        lambda p: F.struct(unescape(F.regexp_extract(p, pattern, 1)).alias("role"), unescape(F.regexp_extract(p, pattern, 2)).alias("text")),
    )


def trained_text(formatted: Column, loss_start: Column, loss_end: Column) -> Column:
    return unescape(F.substring(formatted, loss_start + 1, loss_end - loss_start))


def digests(examples: DataFrame) -> DataFrame:
    """What :func:`format_chat` wrote, read back: one row per conversation.

    Turns are parsed from the example that holds all of them, the trained text from every
    example's mask; only that text and the digests are shuffled, never the contexts.
    """
    turns = parse(F.col("formatted"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id", "example",
        F.when(F.col("last"), F.struct(F.size(turns).cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))).alias("all"),
        trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
    )
    joined = read.groupBy("conv_id").agg(F.max("all").alias("all"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"))
    return joined.select("conv_id", "all.n_turns", "all.turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "all.formatted_chars")
