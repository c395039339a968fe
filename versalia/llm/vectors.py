"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosine check, components.

Equal vectors are one class. A class lies in one bucket per table, named by the signs of its
projections on that table's random hyperplanes. Within a bucket all cosines are computed
exactly, as products of matrix blocks; a pair that shares buckets in several tables counts in
the first of them only.
"""

from __future__ import annotations

from itertools import count
from math import acos, ceil, log, log2, pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_blocks, by_key, components, materialize, salted_join, text_batches

THRESHOLD = 0.98
#: Share of the pairs right at the threshold that must meet in some table.
RECALL = 0.9995
BLOCK = 512
SEED = 20240607


def tables_for(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(signs per table, tables): buckets of unrelated vectors stay small as n grows, recall holds."""
    signs = min(62, max(4, ceil(log2(max(n, 2))) + 2))
    together = (1 - acos(threshold) / pi) ** signs
    return signs, max(1, ceil(log(1 - recall) / log(1 - together)))


def planes(dim: int, signs: int, tables: int, seed: int = SEED):
    import numpy as np

    return np.random.default_rng([seed, dim]).standard_normal((dim, signs * tables))


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for ``rows(vec_id, embedding, label)``: one row per row.

    Vectors link when their labels are equal and not null and their cosine (double precision)
    is at least the threshold; vectors of different lengths never do. Null, zero and empty
    vectors and those with null or non-finite components link with nothing. Repeated ids are
    separate vectors, whatever they hold. A null id takes part but is never a component's id,
    unless all ids of the component are null, and isn't kept.
    Other columns are not read. Pairs at the threshold are missed with probability
    1 - ``recall``; nothing below it links.
    """
    text_batches(rows.sparkSession, 10_000)
    wide = rows.schema["embedding"].dataType.simpleString() == "array<double>"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if wide else "array<float>").alias("embedding"), F.col("label").cast("long").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    for seed in count(2, 2):
        hashed = rows.filter(usable).withColumns({"h": F.xxhash64("embedding", F.lit(seed)), "g": F.xxhash64(F.lit(seed + 1), "embedding")})
        kinds = hashed.groupBy("label", "h", "g", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        # classes have numbers of their own: ids may repeat or be null
        kinds = reps = materialize(kinds.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
        # vectors find their class by the hashes, which must tell all classes of a label apart
        if kinds.groupBy("label", "h", "g").count().filter("count > 1").isEmpty():
            break
    most = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    signs, tables = tables_for(most, threshold, recall)

    def sign(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            sizes = batch["embedding"].map(len).to_numpy()
            for dim in np.unique(sizes):
                part = batch[sizes == dim]
                x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                up = (x @ planes(int(dim), signs, tables) >= 0).reshape(len(x), tables, signs)
                key = (up * (np.int64(1) << np.arange(signs, dtype=np.int64))).sum(axis=2)
                yield pd.DataFrame({"node": part["node"].to_numpy(), "label": part["label"].to_numpy(), "dim": int(dim), "keys": list(key)})

    signed = materialize(reps.select("node", "label", "embedding").mapInPandas(sign, "node long, label long, dim int, keys array<long>"), "vector-signs")
    placed = signed.select("node", "label", "dim", F.posexplode("keys").alias("t", "key"))
    blocks = bucket_blocks(placed, ["label", "dim", "t", "key"], "node", block)
    full = blocks.join(reps.select("node", "embedding", "copies"), "node").join(signed.select("node", "keys"), "node")

    def compare(frame, starts):
        import numpy as np
        import pandas as pd

        from .common import forest

        node, copies, table = (frame[c].to_numpy() for c in ("node", "copies", "t"))
        blk, blk_a, blk_b = (frame[c].to_numpy() for c in ("blk", "blk_a", "blk_b"))
        keys, vectors = frame["keys"].to_numpy(), frame["embedding"].to_numpy()
        found, n_links = [], np.zeros(len(frame), np.int64)
        for lo, hi in zip(starts, [*starts[1:], len(frame)], strict=True):
            a, b = lo + np.flatnonzero(blk[lo:hi] == blk_a[lo]), lo + np.flatnonzero(blk[lo:hi] == blk_b[lo])
            if not len(a) or not len(b) or (blk_a[lo] == blk_b[lo] and len(a) < 2):
                continue

            def unit(at):
                x = np.stack(vectors[at]).astype(np.float64)
                return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

            u = unit(a)
            i, j = np.nonzero(u @ (u if blk_a[lo] == blk_b[lo] else unit(b)).T >= threshold)
            i, j = a[i], b[j]
            if blk_a[lo] == blk_b[lo]:
                i, j = i[i < j], j[i < j]
            found.append((i, j))
            t = int(table[lo])
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                k = {x: n for n, x in enumerate(np.union1d(p, q))}
                s = np.stack([keys[x][:t] for x in k]) if t else np.zeros((len(k), 0))
                here = np.array(list(k))
                pi_, qi = np.searchsorted(here, p), np.searchsorted(here, q)
                new = ~(s[pi_] == s[qi]).any(axis=1)
                np.add.at(n_links, p[new], copies[q[new]])
                np.add.at(n_links, q[new], copies[p[new]])
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        root = forest(len(frame), i, j)
        far, some = np.flatnonzero(root != np.arange(len(frame))), np.flatnonzero(n_links)
        return pd.DataFrame({
            "a": np.concatenate([node[far], node[some]]), "b": np.concatenate([node[root[far]], node[some]]),
            "n": np.concatenate([np.zeros(len(far), np.int64), n_links[some]]),
        })

    met = materialize(by_key(full, ["label", "dim", "t", "key", "blk_a", "blk_b"], compare, "a long, b long, n long"), "vector-links")
    joined = components(met.filter("n = 0"))
    counts = met.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    of = materialize(kinds.select("node", "least").join(joined, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "vector-components")
    named = salted_join(of.select("node", "component"), of.groupBy("component").agg(F.min("least").alias("component_id")), ["component"], "node")
    told = kinds.select("node", "label", "h", "g", "copies").join(counts, "node", "left").join(named, "node").select("label", "h", "g", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    linked = salted_join(hashed.select("vec_id", "label", "h", "g"), told, ["label", "h", "g"], "vec_id").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
