"""Helpers shared by the corpus operators: storage, batching, bucket blocks, components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Open scopes: lists of the scratch folders made within them, innermost last.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, ``spark.checkpoint.dir``.

    Where it is unset a local session takes a folder under the working directory; on a cluster, where
    that would be each machine's own, it is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{os.path.abspath('spark-warehouse')}/shared"


def _file_system(spark: SparkSession, path: str) -> tuple:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, deleted with the scope it is made in."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def until_exit(spark: SparkSession, path: str) -> None:
    """Delete a written folder when the driver ends, if it is still there: results are read from it after the call that made it."""
    fs, there = _file_system(spark, path)
    fs.deleteOnExit(there)


def _delete(spark: SparkSession, path: str) -> None:
    fs, there = _file_system(spark, path)
    fs.delete(there, True)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes the scratch folders made within: for steps whose result doesn't read them any more."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send at most ``rows`` rows at a time to Python workers: texts are long, and the session's default is 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """:func:`materialize` the frame that ``make`` gives, then delete all scratch that it took to make it."""
    path = scratch_path(spark, name)
    with scratch_scope(spark):
        df = make()
        df.write.parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a ``materialize``d frame that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rpartition("/")[0])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside a row, so that lambdas in ``body`` don't evaluate it again."""
    return F.transform(F.array(value), body)[0]


#: Elements that :func:`running` folds at once; growing a list copies it.
RUN = 256


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of ints, ``op`` over 0 and all elements before it (``op`` associative, 0 neutral).

    Built-in functions grow an array by copying it, so blocks are folded apart and shifted by the fold of
    the blocks before.
    """
    first = F.expr("struct(0 as t, cast(array() as array<int>) as out)")

    def fold(items: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(items, first, lambda a, x: F.struct(op(a["t"], of(x)).alias("t"), F.array_append(a["out"], a["t"]).alias("out")))

    def joined(blocks: Column) -> Column:
        return let(
            F.struct(blocks.alias("b"), fold(blocks, lambda b: b["t"])["out"].alias("shift")),
            lambda s: F.flatten(F.transform(s["b"], lambda b, k: F.transform(b["out"], lambda v: op(v, F.get(s["shift"], k))))),
        )

    return joined_of(values, lambda block: fold(block, lambda x: x), joined)


def joined_of(values: Column, of: Callable[[Column], Column], then: Callable[[Column], Column]) -> Column:
    """``then`` over the array of ``of`` of each block of ``RUN`` elements."""
    last = F.greatest(F.ceil(F.size(values) / RUN).cast("int") - 1, F.lit(0))
    return let(F.transform(F.sequence(F.lit(0), last), lambda k: of(F.slice(values, k * RUN + 1, F.lit(RUN)))), then)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return let(
        F.split(F.coalesce(text, F.lit("")), SPACE),
        lambda parts: F.greatest(
            F.size(parts)
            - F.when(parts[0] == "", 1).otherwise(0)
            - F.when(F.element_at(parts, -1) == "", 1).otherwise(0),
            F.lit(0),
        ),
    )


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def boxed(df: DataFrame, out: str = "row") -> Column:
    """All columns of ``df`` in one struct, so that no name of a step can clash with them; :func:`unboxed` gives them back."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(out)


def unboxed(df: DataFrame, columns: list[str], box: str = "row", **changed: Column) -> DataFrame:
    """The columns in ``box``, those in ``changed`` with new values."""
    return df.select(*(changed[c].alias(c) if c in changed else F.col(f"{box}.`{c}`") for c in columns))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``(row, half, other)``: rows boxed, with two hashes that name a row by its file and place.

    A frame that isn't read from files is written out first.
    """
    place = F.concat_ws(":", "_metadata.file_path", "_metadata.row_index")
    keys = [F.xxhash64("place").alias("half"), F.xxhash64(F.lit(1), "place").alias("other")]
    if "_metadata" not in (c.lower() for c in docs.columns):
        try:
            return docs.select(boxed(docs), place.alias("place")).select("row", *keys)
        except AnalysisException:
            pass
    return materialize(docs.select(boxed(docs)), "rows").select("row", place.alias("place")).select("row", *keys)


def salted_join(rows: DataFrame, per_key: DataFrame, keys: list[str], spread: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join many ``rows`` to the one row of ``per_key`` that has their key, by (key, salt).

    Rows are dealt over ``salts`` by a hash of the column ``spread``, so a key that holds a
    large part of all rows is no single task; ``per_key``, one row a key, is repeated.
    """
    few = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    many = rows.withColumn("_salt", F.pmod(F.xxhash64(spread, F.lit(1)), F.lit(salts)).cast("int"))
    return many.join(few, [*keys, "_salt"], how).drop("_salt")


def by_key(df: DataFrame, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    """Run ``fn(frame, starts)`` over rows hash-dealt and sorted by the non-null ``keys``.

    ``frame`` (pandas) holds whole groups, as many as an Arrow batch brings, and ``starts`` the
    first row of each; unlike with ``applyInPandas``, small groups share the call. Groups that
    span batches are held as a whole, so callers bound group sizes first.
    """
    names = list(keys)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        held = None
        for batch in batches:
            if not len(batch):
                continue
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            cuts = np.zeros(len(frame), bool)
            cuts[0] = True
            for k in names:
                v = frame[k].to_numpy()
                cuts[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(cuts)
            held = frame.iloc[starts[-1] :]
            if len(starts) > 1:
                yield fn(frame.iloc[: starts[-1]], starts[:-1])
        if held is not None:
            yield fn(held, np.zeros(1, int))

    return df.repartition(*names).sortWithinPartitions(*names).mapInPandas(run, schema)


def bucket_blocks(rows: DataFrame, keys: list[str], row_id: str, block: int, salts: int = 8) -> DataFrame:
    """Deal the rows of each bucket into blocks of about ``block`` rows and pair the blocks.

    Adds ``blk``, ``blk_a`` and ``blk_b`` (``blk_a <= blk_b``): all rows with equal keys and
    equal (blk_a, blk_b) must be compared, rows of ``blk_a`` against rows of ``blk_b``. Every
    pair of rows of a bucket meets in exactly one block pair. Buckets of one row are left out.
    The join with the buckets' sizes is salted. A hot bucket of n rows becomes (n / block)^2 / 2 independent tasks instead of one.
    """
    sizes = (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        .select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_nb"))
    )
    met = salted_join(rows, sizes, keys, row_id, salts=salts)
    blk = F.pmod(F.xxhash64(row_id), F.col("_nb")).cast("int")
    return (
        met.withColumn("blk", blk)
        .withColumn("_other", F.explode(F.expr("sequence(0, _nb - 1)")))
        .withColumn("blk_a", F.least("blk", "_other"))
        .withColumn("blk_b", F.greatest("blk", "_other"))
        .drop("_other", "_nb")
    )


def forest(n: int, a, b):
    """Roots of 0..n-1 under links a-b (numpy index arrays): smallest index of each component."""
    import numpy as np

    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        live = root[a] != root[b]
        a, b = a[live], b[live]
    return root


def components(links: DataFrame, salts: int = 8) -> DataFrame:
    """Connected components of ``links(a long, b long)``: ``(node, component)``, the smallest node reachable.

    Alternating large-star and small-star rounds. Per-node minima are pre-aggregated before
    their shuffle; joining them back to a hub's links is salted, so that a hub with a
    large part of all links is spread over tasks. Each round is written to the shared folder.
    Null ends and loops are ignored; nodes without a link don't appear.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(low, ["u", "salt"])
        if large:
            out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.filter("salt = 0").select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    start = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    edges = materialize(start.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = mark(edges)
    while seen[0]:
        after = materialize(star(star(edges, True), False), "links")
        now = mark(after)
        discard(edges)
        edges = after
        if now == seen:
            break
        seen = now
    # every node now points straight at its smallest; those are nodes of their own too
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
