"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole buckets, bit-sliced comparison.

Within a bucket, fingerprints are stored vertically: word p of a block holds bit p of 64
fingerprints. A query fingerprint is compared with all 64 at once by carry-save counters
(one machine word per binary digit of the distances); blocks in which every distance
exceeds the radius are abandoned after each few planes.

Two fingerprints within the radius r agree in at least b - r of b bands, so bucketing by
every choice of b - r bands misses no link. b only sets how many rows share a bucket; it is
chosen from the number of distinct fingerprints.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_blocks, by_key, components, keyed_rows, materialize, salted_join, text_batches, unboxed

SHINGLE_WORDS = 4
RADIUS = 4
BITS = 64
BLOCK = 1024
#: Planes between two looks at which blocks can be abandoned.
STRIDE = 8


def fingerprint(text: str | None, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of a text's lower-cased (A-Z) word shingles; 0 without a word."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    k = words_in_shingle
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= k:
        hashes = np.array([xxh64_intdigest(whole, 42)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        first, last = (end - size)[: 1 - k].tolist(), end[k - 1 :].tolist()
        hashes = np.fromiter((xxh64_intdigest(whole[a:b], 42) for a, b in zip(first, last, strict=True)), np.uint64, len(first))
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", words_in_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` (any columns but the text are kept; one of this name is replaced) with ``fingerprint_bits long``."""
    kept = [c for c in docs.columns if c not in (text, "fingerprint_bits")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [fingerprint(x.as_py(), words_in_shingle) for x in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.int64())], [*kept, "fingerprint_bits"])

    return docs.select(*kept, text).mapInArrow(run, f"{schema}, fingerprint_bits long")


def bands(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the tables for n distinct fingerprints; any link agrees under one of them."""

    def cost(b: int) -> float:
        return comb(b, radius) * (4 * BITS + n / 2.0 ** (BITS * (b - radius) / b))

    b = min(range(radius + 1, radius + 7), key=cost)
    edges = [BITS * i // b for i in range(b + 1)]
    band = [sum(1 << k for k in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(band[i] for i in chosen) for chosen in combinations(range(b), b - radius)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near(bits, group, is_query, is_item, radius: int = RADIUS, at_once: int = 1 << 14):
    """Index pairs (query, item) of one group within the radius, by bit-sliced comparison.

    ``bits`` uint64 fingerprints, ``group`` ascending group numbers from 0, ``is_query`` and
    ``is_item`` masks. Yields arrays; a row that is both meets each other row once (query < item).
    """
    import numpy as np

    items = np.flatnonzero(is_item)
    if not len(items) or not is_query.any():
        return
    groups = int(group[-1]) + 1
    count = np.bincount(group[items], minlength=groups)
    words = -(-count // 64)
    base = np.cumsum(words) - words
    rank = np.arange(len(items)) - (np.cumsum(count) - count)[group[items]]
    lane = np.full((int(words.sum()), 64), -1, np.int64)
    lane[base[group[items]] + rank // 64, rank % 64] = items
    planes = np.empty((len(lane), BITS), np.uint64)
    for a in range(0, len(lane), 2048):
        b = np.unpackbits(bits[lane[a : a + 2048]].view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
        planes[a : a + 2048] = np.packbits(b.transpose(0, 2, 1), axis=2, bitorder="little").reshape(-1, BITS, 8).copy().view(np.uint64)[:, :, 0]
    planes = np.ascontiguousarray(planes.T)
    void = ~np.packbits(lane >= 0, axis=1, bitorder="little").view(np.uint64)[:, 0]
    queries = np.flatnonzero(is_query)
    per = words[group[queries]]
    end = np.cumsum(per)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for lo in range(0, int(end[-1]), at_once):
        pair = np.arange(lo, min(lo + at_once, int(end[-1])))
        which = np.searchsorted(end, pair, side="right")
        q = queries[which]
        w = base[group[q]] + pair - (end - per)[which]
        value, gone = bits[q], void[w]
        one, two, four = (np.zeros(len(q), np.uint64) for _ in range(3))
        for p in range(BITS):
            x = planes[p, w] ^ (np.uint64(0) - (value >> np.uint64(p) & np.uint64(1)))
            carry = one & x
            one ^= x
            carry, two = two & carry, two ^ carry
            gone |= four & carry  # eight or more
            four ^= carry
            if p % STRIDE == STRIDE - 1:
                above, even = np.zeros(len(q), np.uint64), np.full(len(q), full)
                for digit, c in ((4, four), (2, two), (1, one)):
                    if radius & digit:
                        even &= c
                    else:
                        above |= even & c
                        even &= ~c
                gone |= above
                live = gone != full
                if not live.all():
                    q, w, value, gone, one, two, four = (v[live] for v in (q, w, value, gone, one, two, four))
                if not len(q):
                    break
        if len(q):
            hit, at = np.nonzero(np.unpackbits((~gone).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = q[hit], lane[w[hit], at]
            keep = (a < b) | ~(is_item[a] & is_query[b])
            yield a[keep], b[keep]


def links(classes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between the ``node``s of distinct ``fingerprint_bits`` that join all near ones.

    Each compared pair of blocks yields a spanning forest of the links it finds, not every
    link, so a group of n near copies yields O(n) rows.
    """
    if not 0 <= radius < 8:
        raise ValueError("the counters have three binary digits")
    masks = bands(classes.count(), radius)
    rows = classes.select(
        "fingerprint_bits", "node",
        F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fingerprint_bits").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for t, m in enumerate(masks)))).alias("s"),
    ).select("fingerprint_bits", "node", "s.t", "s.key")

    def compare(frame, starts):
        import numpy as np
        import pandas as pd

        from .common import forest

        bits, node = frame["fingerprint_bits"].to_numpy().view(np.uint64), frame["node"].to_numpy()
        group = np.zeros(len(frame), np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        blk, a, b = (frame[c].to_numpy() for c in ("blk", "blk_a", "blk_b"))
        found = list(near(bits, group, blk == a, blk == b, radius))
        left, right = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        root = forest(len(frame), left, right)
        far = np.flatnonzero(root != np.arange(len(frame)))
        return pd.DataFrame({"a": node[far], "b": node[root[far]]})

    blocks = bucket_blocks(rows, ["t", "key"], "fingerprint_bits", block)
    return by_key(blocks, ["t", "key", "blk_a", "blk_b"], compare, "a long, b long")


def class_components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fingerprint_bits, component, component_id)`` of the distinct fingerprints in ``prints(doc_id, fingerprint_bits)``.

    ``component`` is the smallest fingerprint reachable over links, so documents that share an id or have none
    stay apart; ``component_id`` is the smallest id of the component's documents, null if none has one.
    """
    classes = materialize(prints.groupBy("fingerprint_bits").agg(F.min("doc_id").alias("least")), "simhash-classes")
    joined = components(links(classes.select("fingerprint_bits", F.col("fingerprint_bits").alias("node")), radius))
    of = classes.join(joined.withColumnRenamed("node", "fingerprint_bits"), "fingerprint_bits", "left").withColumn("component", F.coalesce("component", "fingerprint_bits"))
    of = materialize(of, "simhash-components")
    return salted_join(of.select("fingerprint_bits", "component"), of.groupBy("component").agg(F.min("least").alias("component_id")), ["component"], "fingerprint_bits")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, words_in_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row per row of ``docs``.

    Null texts count as empty; texts without a word have fingerprint zero and are linked like
    any other. ``component_id`` is the smallest id reachable over links; rows with a null id
    are linked too and lend no id. Repeated rows stay repeated; different texts under one id are
    different documents. An empty table gives an empty result. Other columns are not read.
    """
    text_batches(docs.sparkSession)
    prints = materialize(fingerprints(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")), "text", words_in_shingle), "simhash")
    # a fingerprint that very many documents share is dealt over the salts
    met = salted_join(prints, class_components(prints, radius), ["fingerprint_bits"], "doc_id")
    return met.select("doc_id", F.lpad(F.lower(F.hex("fingerprint_bits")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, words_in_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` without near copies: of each component of :func:`near_duplicates` one row, that of the smallest id.

    Null ids come last, ties go by fingerprint, then by place in the files. Null and empty texts are one
    component; an empty table gives an empty one; other columns pass through whatever their names.
    """
    text_batches(docs.sparkSession)
    rows = keyed_rows(docs)
    narrow = rows.select(F.col(f"row.`{doc_id}`").cast("long").alias("doc_id"), "half", "other", F.col(f"row.`{text}`").cast("string").alias("text"))
    prints = materialize(fingerprints(narrow, "text", words_in_shingle), "simhash")
    met = salted_join(prints, class_components(prints, radius), ["fingerprint_bits"], "half")
    first = met.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fingerprint_bits", "half", "other")).alias("x"))
    # what is kept grows with the corpus: never broadcast
    kept = rows.join(first.select("x.half", "x.other").hint("merge"), ["half", "other"], "left_semi")
    return unboxed(kept, docs.columns)
