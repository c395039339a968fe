"""Token-id output: documents packed into fixed-length sequences by best-fit decreasing.

A document's ids end with an end-of-text id. Documents longer than a sequence are split: full
sequences first, then what remains. Remainders, longest first, go where the least room is
left that suffices; a segment tree over capacities finds that in O(log length).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_batches

LENGTH = 2048
#: Ids a worker packs at once. Bins never cross such a window, so memory is bounded by it.
WINDOW = 1 << 21
#: Rows a worker gathers at most in a window.
WINDOW_ROWS = 20_000


def token_ids(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids array<int>`` in place of the text, by the tiktoken rank file at ``ranks``.

    Null texts count as empty; strings of special tokens are ordinary text. Rows are handled one by one, so
    repeated rows and empty tables need no rule; other columns pass through, one named like ``ids`` is replaced.
    """
    text_batches(docs.sparkSession)
    with open(ranks, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [f for f in docs.schema if f.name not in (text, ids)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{ids}` array<int>"])

    def run(batches):
        import base64

        import numpy as np
        import pyarrow as pa
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        for batch in batches:
            texts, at = batch.column(text), 0
            while at < len(texts):
                held, total, first = [], 0, at
                while at < len(texts) and total < 1 << 20:
                    held.append(np.array(encode(texts[at].as_py() or ""), np.int32))
                    total += len(held[-1])
                    at += 1
                ends = pa.array(np.cumsum([0, *map(len, held)], dtype=np.int32))
                part = batch.slice(first, at - first)
                array = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(held)))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), array], [*(f.name for f in kept), ids])

    return docs.mapInArrow(run, schema)


class Capacities:
    """Open bins by the room left in them; finds the tightest that takes a length."""

    def __init__(self, top: int) -> None:
        self.leaves = 1 << top.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(top + 1)]

    def add(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        at = self.leaves + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) with the least room of at least ``need``, removed; None if there is none."""
        at = self.leaves + need
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, self.bins[room].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of the indexes of ``sizes`` (each 1..length), by best-fit decreasing; ties by index."""
    bins: list[list[int]] = []
    open_bins = Capacities(length)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = open_bins.take(sizes[i])
        if found:
            room, which = found
            bins[which].append(i)
        else:
            room, which = length, len(bins)
            bins.append([i])
        if room > sizes[i]:
            open_bins.add(room - sizes[i], which)
    return bins


def pack(docs: DataFrame, end_id: int, doc_id: str = "doc_id", ids: str = "ids", length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """Sequences ``(pack_id, ids, n_ids, cu_seqlens, position_resets, segments)`` of ``docs``.

    ``ids`` is a row of the id matrix: ``length`` little-endian uint16 (uint32 if an id needs it, then
    ``width`` is 4), padded with ``end_id``. ``cu_seqlens`` are the cumulative segment lengths from 0,
    ``position_resets`` the places where positions start again from 0 (those of the segments
    and of the padding), ``segments`` says what each segment is: (doc_id, doc_row, piece,
    n_pieces). No id is lost: pieces of a document concatenate to its ids. A null or empty
    list of ids becomes the end id alone; null ids and repeated rows are kept; ties go by row.
    Packing stays within windows of a partition, so nothing is shuffled.
    """
    key = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 33
        made = rows = 0
        held: list = []

        def packed():
            nonlocal made
            pieces = []
            for key_, row, x in held:
                n = -(-len(x) // length)
                pieces += [(key_, row, k, n, x[k * length : (k + 1) * length]) for k in range(n)]
            wide = max((int(x.max()) for *_, x in pieces), default=0) > 0xFFFF
            kind = np.dtype("<u4" if wide else "<u2")
            out = []
            for b in best_fit([len(p[4]) for p in pieces], length):
                line = np.full(length, end_id, kind)
                ends = np.cumsum([0, *(len(pieces[i][4]) for i in b)])
                for i, a, z in zip(b, ends, ends[1:], strict=False):
                    line[a:z] = pieces[i][4]
                out.append({
                    "pack_id": part | made, "ids": line.tobytes(), "width": kind.itemsize, "n_ids": int(ends[-1]), "cu_seqlens": ends.tolist(),
                    "position_resets": [x for x in ends.tolist() if x < length],
                    "segments": [dict(zip(("doc_id", "doc_row", "piece", "n_pieces"), pieces[i][:4], strict=True)) for i in b],
                })
                made += 1
            return out

        def frames(out):
            for at in range(0, len(out), 512):
                yield pa.RecordBatch.from_pylist(out[at : at + 512], schema=pa.schema([
                    ("pack_id", pa.int64()), ("ids", pa.binary()), ("width", pa.int32()), ("n_ids", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
                    ("segments", pa.list_(pa.struct([("doc_id", kinds), ("doc_row", pa.int64()), ("piece", pa.int32()), ("n_pieces", pa.int32())]))),
                ]))

        total, kinds = 0, pa.null()
        for batch in batches:
            kinds = batch.schema.field(doc_id).type
            lists = batch.column(ids)
            for i, k in enumerate(batch.column(doc_id).to_pylist()):
                v = lists[i].values
                x = np.empty(0 if v is None else len(v), np.int64) if v is None or not len(v) else np.asarray(v, dtype=np.int64)
                held.append((k, part | rows, np.append(x, end_id).astype(np.uint32)))
                rows += 1
                total += len(x) + 1
                if total >= window or len(held) >= WINDOW_ROWS:
                    yield from frames(packed())
                    held, total = [], 0
        if held:
            yield from frames(packed())

    schema = f"pack_id long, ids binary, width int, n_ids int, cu_seqlens array<int>, position_resets array<int>, segments array<struct<doc_id:{key},doc_row:long,piece:int,n_pieces:int>>"
    return docs.select(doc_id, ids).mapInArrow(run, schema)


def pieces(packs: DataFrame) -> DataFrame:
    """The segments of packed sequences, read back: ``(doc_id, doc_row, piece, n_pieces, pack_id, start, room, n_ids, ids)``."""
    room = (F.octet_length("ids") / F.col("width") - F.col("n_ids")).cast("long")
    one = packs.select("pack_id", "ids", "width", "cu_seqlens", room.alias("room"), F.posexplode("segments").alias("k", "s"))
    start, end = F.get("cu_seqlens", F.col("k")), F.get("cu_seqlens", F.col("k") + 1)
    return one.select("s.*", "pack_id", start.alias("start"), "room", (end - start).alias("n_ids"), F.substring("ids", start * F.col("width") + 1, (end - start) * F.col("width")).alias("ids"))


def summary(packs: DataFrame) -> DataFrame:
    """One row per packed document, from its segments: ``doc_id, n_ids, n_pieces, first_pack, first_start, room, pieces_sha256``.

    ``n_ids`` counts the end id; ``first_pack`` and ``first_start`` say where its first piece begins, ``room`` how
    many places are padding in the sequences that hold its pieces; ``pieces_sha256`` is the digest of the
    comma-joined hex digests of the document's pieces (little-endian ids), in order. Only digests are
    shuffled. An empty table gives no row; repeated rows and null ids are documents of their own.
    """
    at = F.struct("piece", "pack_id", "start", F.sha2("ids", 256).alias("h"))
    told = pieces(packs).select("doc_id", "doc_row", "n_ids", "room", at.alias("p"))
    first = F.get("p", F.lit(0))
    return told.groupBy("doc_row", "doc_id").agg(F.sum("n_ids").alias("n_ids"), F.sum("room").alias("room"), F.sort_array(F.collect_list("p")).alias("p")).select(
        "doc_id", "n_ids", F.size("p").cast("long").alias("n_pieces"), first["pack_id"].alias("first_pack"), first["start"].cast("long").alias("first_start"), "room",
        F.sha2(F.array_join(F.transform("p", lambda x: x["h"]), ","), 256).alias("pieces_sha256"),
    )


def written(packs: DataFrame) -> DataFrame:
    """Write the sequences to the shared folder and read them again."""
    return materialize(packs, "packs")


def fill(packs: DataFrame) -> DataFrame:
    """``(packs, ids, places, share)``: how full the sequences are, in one row."""
    places = F.octet_length("ids") / F.col("width")
    return packs.agg(F.count(F.lit(1)).alias("packs"), F.sum("n_ids").alias("ids"), F.sum(places).cast("long").alias("places"), (F.sum("n_ids") / F.sum(places)).alias("share"))


def write_matrix(packs: DataFrame, path: str, end_id: int, width: int = 2) -> None:
    """Binary id matrices under ``path/ids``, and ``path/index`` (Parquet) with the rest of each sequence.

    A file is a matrix of little-endian numbers of ``width`` bytes, a sequence a row, with one more column
    that holds ``end_id`` (it ends the rows for Spark's text writer). The files of a partition of ``packs``, read
    from files, have its number in both folders, and rows in the same order. Sequences of another width are an error.
    """
    right = F.assert_true(F.col("width") == width, F.lit("sequences of another width")).isNull()
    end = end_id.to_bytes(width, "little").decode("latin-1")
    # bytes stay as they are: the cast doesn't decode, and this encoding has a character for every byte
    packs.filter(right).select(F.col("ids").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", end).text(f"{path}/ids")
    packs.select("pack_id", "n_ids", "cu_seqlens", "position_resets", "segments").write.parquet(f"{path}/index")
