"""Mixing sources to target weights by pivotal dependent rounding.

Every document starts with the expected number of copies that brings its source to its target.
Whole copies are sure; the fractions are settled by pairs: mass, counted in words, moves at random
from one document of the pair to the other until one fraction is 0 or 1, in a way that keeps
each document's expectation and the pair's total. What remains fractional in a bucket, one document at
most, meets those of other buckets in the next level of a reduction tree, until one per
source is left and rounded. So a source's words differ from its target by one document at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_key, free_name, keyed_rows, materialize, salted_join, text_batches, unboxed, word_count

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents that one bucket settles, and buckets whose remainders meet in the next level.
BUCKET = 2048
#: Rows of one source, id and size that may share a bucket, if they aren't one part in ``HOT`` of all rows.
MOST_ALIKE, HOT = 256, 1 << 15
SEED = 71


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``(source, key, n_docs, source_size, target)`` for ``sizes(source, size)``: one row per source.

    Sources in code point order, null last, take the weights in turn and share the sum of all
    sizes; none gets more than ``most`` times its size, and what is above is shared again by
    weight among the rest. That is: target = min(most * size, weight * level), where the level
    makes targets add up. Source counts are aggregated first; the level takes one task over a row per source.
    """
    per = sizes.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    share = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(turn - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", share).withColumn("cap", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    everyone = Window.partitionBy()
    # what follows is the whole without what is before: a frame up to the end would cost the square of the sources
    rest = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    per = per.withColumn("level", (F.sum("source_size").over(everyone) - below) / rest).withColumn("at", F.row_number().over(order))
    found = F.min(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct("at", "level"))).over(everyone)["level"]
    level = F.coalesce(found, F.lit(float("inf")))
    return per.select("source", "key", "n_docs", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def settle(share, size, draw):
    """Pivotal rounding of one bucket: ``share`` in [0, 1) becomes 0 or 1 except for one row at most.

    The sum of share * size stays. ``draw()`` gives uniform numbers. Changes ``share`` in place.
    """
    hold = None
    for i in range(len(share)):
        if not 0 < share[i] < 1:
            continue
        if hold is None:
            hold = i
            continue
        p, q, a, b = share[hold], share[i], size[hold], size[i]
        up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)  # words that can move to and from the held row
        if draw() * (up + down) < down:
            full, words = (1 - p) * a <= q * b, up
            p, q = (1.0, q - words / b) if full else (p + words / a, 0.0)
        else:
            empty, words = p * a <= (1 - q) * b, down
            p, q = (0.0, q + words / b) if empty else (p - words / a, 1.0)
        p, q = (round(x) if min(x, 1 - x) < 1e-12 else x for x in (p, q))
        share[hold], share[i] = p, q
        if not 0 < p < 1:
            hold = i if 0 < q < 1 else None
    return share


def copies(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, row: str | None = None, place: str | None = None) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies)`` and, if ``row`` lists columns, a struct ``row`` of them: one row per row of ``docs``.

    ``place``, a column of numbers that stay the same however often they are read, tells rows of one source, id and
    size apart; without it the rows are written out to number them.

    ``taken`` = ``copies`` * ``size``. Null sizes count as 0; documents of size 0 carry no words and
    are kept once. Sources are compared as they are, null being one of them. Reruns agree: draws
    depend on the seed, the source and the bucket, and rows of a bucket go from large to small,
    ties by id. An empty table gives an empty result; other columns are not read.
    """
    text_batches(docs.sparkSession, 10_000)  # narrow rows
    if not place:
        place = free_name(docs, "place")
        docs = materialize(docs.withColumn(place, F.monotonically_increasing_id()), "mix-places")
    carried = [F.struct(*(c.strip() for c in row.split(","))).alias("row")] if row else [F.lit(None).cast("long").alias("row")]
    key = F.concat(F.when(F.col(source).isNull(), "0").otherwise("1"), F.coalesce(F.col(source).cast("string"), F.lit("")))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), key.alias("key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"), F.col(place).alias("place"), *carried)
    per = materialize(targets(rows, weights, most), "mix-sources")
    deal = F.ceil(F.col("n_docs") / BUCKET).cast("long")
    start = salted_join(rows.drop("source"), per.drop("source"), ["key"], "doc_id").withColumn("buckets", deal)
    # rows of one id and size go by their hash to one bucket; where very many share it, they are dealt out by their place
    n = per.agg(F.sum("n_docs")).first()[0] or 0
    most_alike = max(MOST_ALIKE, -(-n // HOT))
    alike = rows.groupBy("key", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_alike).select(F.col("key").alias("key_"), F.col("doc_id").alias("id_"), F.col("size").alias("size_"), F.ceil(F.col("n") / most_alike).alias("parts"))
    # at most HOT rows, whatever the input
    start = start.join(F.broadcast(alike), (F.col("key") == F.col("key_")) & F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("size") == F.col("size_")), "left")
    part = F.coalesce(F.pmod(F.col("place"), F.col("parts")), F.lit(0))
    want = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(1.0)
    start = start.withColumn("whole", F.floor(want).cast("long")).withColumn("share", want - F.floor(want))
    start = start.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)) + part, F.col("buckets")))
    start = start.select("key", "bucket", "buckets", "doc_id", "size", "place", "row", "source_size", "target", "whole", "share")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in start.schema)

    def bucketwise(level: int):
        def run(frame, starts):
            from zlib import crc32

            import numpy as np

            frame = frame.assign(_n=frame["doc_id"].fillna(-(2**63)).astype("int64") if frame["doc_id"].isna().any() else frame["doc_id"])
            share = frame["share"].to_numpy().copy()
            keys, buckets, ids, sizes, places = (frame[c].to_numpy() for c in ("key", "bucket", "_n", "size", "place"))
            for lo, hi in zip(starts, [*starts[1:], len(frame)], strict=True):
                order = lo + np.lexsort((places[lo:hi], ids[lo:hi], -sizes[lo:hi]))  # small ones last: what stays open is small
                rng = np.random.default_rng([seed, level, crc32(keys[lo].encode()), int(buckets[lo])])
                draws = iter(rng.random(len(order)).tolist())
                share[order] = settle(share[order].tolist(), sizes[order].tolist(), draws.__next__)
            return frame.assign(share=share).drop(columns="_n")

        return run

    most_buckets = per.agg(F.max(deal)).first()[0] or 0
    open_rows, settled, level = start, [], 0
    while most_buckets:
        step = materialize(by_key(open_rows, ["key", "bucket"], bucketwise(level), schema), "mix")
        settled.append(step.filter("share <= 0 or share >= 1"))
        open_rows = step.filter("share > 0 and share < 1")
        if most_buckets == 1:
            break
        level, most_buckets = level + 1, -(-most_buckets // BUCKET)
        open_rows = open_rows.withColumn("bucket", F.floor(F.col("bucket") / BUCKET)).withColumn("buckets", F.ceil(F.col("buckets") / BUCKET))
    # one row a source at most is still open
    draw = (F.pmod(F.xxhash64("key", F.lit(seed), F.lit(2)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    settled.append(open_rows.withColumn("share", F.when(draw < F.col("share"), 1.0).otherwise(0.0)))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    n = (F.col("whole") + F.col("share").cast("long")).alias("copies")
    return out.select("doc_id", "size", "source_size", "target", (n * F.col("size")).alias("taken"), n, *(["row"] if row else []))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """:func:`copies` of documents whose size is their number of words (null text: 0).

    Sizes are written once, so that texts are read once.
    """
    sizes = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).cast("long").alias("size"), F.monotonically_increasing_id().alias("place")), "sizes")
    return copies(sizes, place="place", **options)


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it; rows it doesn't take go.

    Null and empty texts have no words and stay once; ties and repeated rows are told apart by their place in the
    files; an empty table gives an empty one; other columns pass through whatever their names.
    """
    named = keyed_rows(docs)
    of = lambda c: F.col(f"row.`{c}`")
    sizes = materialize(named.select(of(doc_id).alias("doc_id"), of(source).alias("source"), word_count(of(text)).cast("long").alias("size"), "half", "other"), "sizes")
    taken = copies(sizes, row="half, other", place="half", **options).filter("copies > 0").select("row.half", "row.other", "copies")
    # the copies grow with the corpus: dealt out, never broadcast
    met = named.join(taken.hint("merge"), ["half", "other"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return unboxed(met, docs.columns)
