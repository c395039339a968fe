"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its hashed character n-grams and of itself, so
misspellings never met share most of the vector of the word they come from. A window's
vector is the mean of its words'. Scoring is linear up to the softmax, so a word's part of the logit is
one number, computed once for each different word a worker meets. A document's logit is that of
its worst window; windows cover the whole text. A last calibration of logit and length
on labelled documents not used for the weights gives the score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, text_batches

WINDOW, STRIDE = 16, 8
BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
#: Runs of more code points are read in pieces: what stands between joiners, and overlapping slices where that is still long.
LONG = 64
SLICE, SLICE_STEP = 16, 8
JOINERS = re.compile(r"[.,;:_|/\\…()\[\]{}<>\"-]+")
STRIPPED = "#*$%&|<>.,;:!?\"'()[]{}-_…"
#: Bound of the labelled sample: documents of a class. Their texts are learnt from as a whole.
MOST_DOCS = 2500
EPOCHS = 8
SEED = 5
CACHED = 120_000


def words_of(text: str | None) -> list[str]:
    """Lower-case words of a text; a run of more than ``LONG`` code points gives several, which cover all of it."""
    words = (text or "").lower().split()
    if max(map(len, words), default=0) <= LONG:
        return words
    return [x for w in words for x in ([w] if len(w) <= LONG else pieces(w))]


def pieces(run: str) -> list[str]:
    out = []
    for x in [x for x in JOINERS.split(run) if x] or [run]:
        if len(x) <= LONG:
            out.append(x)
        else:
            out += [x[a : a + SLICE] for a in range(0, len(x) - SLICE, SLICE_STEP)] + [x[-SLICE:]]
    return out


def grams(words: list[str], at_once: int = 20_000):
    """:func:`hashed_grams` of many words in bounded memory."""
    import numpy as np

    parts = [hashed_grams(words[a : a + at_once]) for a in range(0, len(words), at_once)]
    shift = np.cumsum([0, *(len(ids) for ids, _ in parts)])
    return np.concatenate([ids for ids, _ in parts]), np.concatenate([starts + n for (_, starts), n in zip(parts, shift, strict=False)])


def hashed_grams(words: list[str]):
    """(bucket ids, starts): hashed n-grams of each word in ``<word>`` form, then the word's own bucket."""
    import numpy as np

    marked = ["<" + (w.strip(STRIPPED) or w) + ">" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    end = np.cumsum(size)
    word = np.repeat(np.arange(len(marked)), size)
    room = end[word] - np.arange(len(code))  # characters from here to the word's end
    hashed, owner = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h * np.uint64(0x100000001B3)
        h[: len(code) - n + 1] ^= (code[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        if n in GRAMS:
            here = room >= n
            hashed.append(h[here])
            owner.append(word[here])
    place = (np.arange(len(code)) - (end - size)[word]).astype(np.uint64)
    with np.errstate(over="ignore"):
        whole = np.add.reduceat((code + np.uint64(7)) * (place * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA0761D6478BD642F)), end - size)
    hashed.append(whole)
    owner.append(np.arange(len(marked)))
    ids, of = np.concatenate(hashed), np.concatenate(owner)
    order = np.argsort(of, kind="stable")
    ids = (ids ^ ids >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    buckets = (ids >> np.uint64(40)).astype(np.int32)[order] % np.int32(BUCKETS)
    return buckets, np.searchsorted(of[order], np.arange(len(marked)))


@dataclass
class Model:
    """``gram``: each bucket's part of a word's logit; ``a`` and ``b``, ``c``: score = sigmoid(a * logit + b + c * log(windows))."""

    gram: object
    bias: float
    a: float
    b: float
    c: float

    def word_logits(self, words: list[str]):
        import numpy as np

        ids, starts = grams(words)
        return np.add.reduceat(self.gram[ids], starts) / np.diff([*starts, len(ids)])

    def worst(self, logits) -> float:
        """Largest window mean of the words' logits."""
        import numpy as np

        n = len(logits)
        if n <= WINDOW:
            return float(logits.mean()) + self.bias if n else self.bias
        total = np.concatenate([[0.0], np.cumsum(logits)])
        start = np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)
        return float((total[start + WINDOW] - total[start]).max() / WINDOW) + self.bias

    def score(self, logit: float, n_words: int) -> float:
        from math import exp

        x = self.a * logit + self.b + self.c * spread(n_words)
        return 1 / (1 + exp(-max(-500.0, min(500.0, x))))


def spread(n_words: int) -> float:
    from math import log1p

    return log1p(n_words / WINDOW)


def fit(docs: list[list[str]], labels: list[int], prior: float, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Train on the words ``docs[i]`` of documents with ``labels[i]``; ``prior``: share of label 1 among all."""
    import numpy as np

    rng = np.random.default_rng(seed)
    if not docs or not 0 < sum(labels) < len(labels):
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))), 0.0)
    aside = np.arange(len(docs)) % 4 == 3
    windows = [(i, d[a : a + WINDOW]) for i, d in enumerate(docs) if not aside[i] for a in range(0, len(d), WINDOW)]
    vocabulary = sorted({x for _, w in windows for x in w})
    number = {x: n for n, x in enumerate(vocabulary)}
    ids, starts = grams(vocabulary) if vocabulary else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    counts = np.diff([*starts, len(ids)])
    toks = [np.array([number[x] for x in w], np.int32) for _, w in windows]
    of, y = np.array([i for i, _ in windows]), np.array([labels[i] for i, _ in windows])
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    ge, gw, gb = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    use = np.ones(len(windows), bool)
    scale, rate = 8.0, 0.3

    def gathered(u):
        n = counts[u]
        at = np.repeat(starts[u] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return ids[at], n

    for epoch in range(epochs):
        if epoch == 1:  # of a positive document only windows that look it are positive
            z = np.concatenate([window_logits(e, w, bias, toks[k : k + 512], ids, starts, counts, scale) for k in range(0, len(toks), 512)])
            best = np.full(len(docs), -np.inf)
            np.maximum.at(best, of, z)
            use = (y == 0) | (z >= np.maximum(best[of] - 1.0, 0)) | (z == best[of])
        pos, neg = rng.permutation(np.flatnonzero(use & (y == 1))), rng.permutation(np.flatnonzero(use & (y == 0)))
        order = rng.permutation(np.concatenate([pos, neg]))
        heavy = min(6.0, max(1.0, len(neg) / max(1, len(pos)) / 2))
        for at in range(0, len(order), 128):
            batch = order[at : at + 128]
            flat = np.concatenate([toks[k] for k in batch])
            n = np.array([len(toks[k]) for k in batch])
            u, inverse = np.unique(flat, return_inverse=True)
            g, per = gathered(u)
            v = np.add.reduceat(e[g], np.cumsum(per) - per, axis=0) / per[:, None]
            h = np.add.reduceat(v[inverse], np.cumsum(n) - n, axis=0) / n[:, None] * scale
            z = h @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p *= np.where(y[batch] == 1, heavy, 1.0)[:, None] / len(batch)
            dh = (p @ w.T) * (scale / n)[:, None]
            back = np.repeat(dh, n, axis=0)
            dv = np.stack([np.bincount(inverse, back[:, d], len(u)) for d in range(DIM)], axis=1) / per[:, None]
            touched, where = np.unique(g, return_inverse=True)
            spread_ = np.repeat(dv, per, axis=0)
            de = np.stack([np.bincount(where, spread_[:, d], len(touched)) for d in range(DIM)], axis=1)
            dw, db = h.T @ p, p.sum(axis=0)
            ge[touched] += (de * de).mean(axis=1)
            gw += dw * dw
            gb += db * db
            e[touched] -= rate * de / np.sqrt(ge[touched])[:, None]
            w -= rate * 0.3 * dw / np.sqrt(gw)
            bias -= rate * 0.3 * db / np.sqrt(gb)
    direction = (w[:, 1] - w[:, 0]) * scale
    model = Model((e @ direction).astype(np.float32), float(bias[1] - bias[0]), 1.0, 0.0, 0.0)
    # calibrate on the documents set aside, weighted to the classes' true shares
    rows = [(i, docs[i]) for i in np.flatnonzero(aside)]
    known = sorted({x for _, t in rows for x in t})
    if known and 0 < sum(labels[i] for i, _ in rows) < len(rows):
        logit = dict(zip(known, model.word_logits(known).tolist(), strict=True))
        x = np.array([[model.worst(np.array([logit[k] for k in words])), spread(len(words)), 1.0] for _, words in rows])
        t = np.array([labels[i] for i, _ in rows], float)
        weight = np.where(t == 1, prior / t.mean(), (1 - prior) / (1 - t.mean()))
        beta = np.zeros(3)
        middle, wide = x[:, 0].mean(), x[:, 0].std() + 1e-9
        x[:, 0] = (x[:, 0] - middle) / wide
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(3) * 0.05
            beta += np.clip(np.linalg.solve(hess, x.T @ (weight * (t - p)) - 0.05 * beta), -2, 2)
        model.a, model.c, model.b = float(beta[0] / wide), float(beta[1]), float(beta[2] - beta[0] * middle / wide)
    return model


def window_logits(e, w, bias, toks, ids, starts, counts, scale):
    import numpy as np

    flat, n = np.concatenate(toks), np.array([len(t) for t in toks])
    u, inverse = np.unique(flat, return_inverse=True)
    per = counts[u]
    at = np.repeat(starts[u] - (np.cumsum(per) - per), per) + np.arange(per.sum())
    v = np.add.reduceat(e[ids[at]], np.cumsum(per) - per, axis=0) / per[:, None]
    z = np.add.reduceat(v[inverse], np.cumsum(n) - n, axis=0) / n[:, None] * scale @ w + bias
    return z[:, 1] - z[:, 0]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 0 by 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most_docs: int = MOST_DOCS) -> Model:
    """Fit on a bounded sample: the whole texts of ``most_docs`` labelled documents of a class
    (smallest hashes of their ids). Of several texts of an id the greatest is learnt from."""
    text_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counted = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = counted.get(1, 0) / max(1, sum(counted.values()))
    chosen = None
    for k in (0, 1):
        part = known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
        chosen = part if chosen is None else chosen.union(part)

    # two times most_docs ids at the most, and one text of each
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen.withColumnRenamed("doc_id", "id")), "id")
    rows = sample.groupBy(F.col("id").cast("long").alias("id"), "toxic").agg(F.max("text").alias("text")).collect()
    rows.sort(key=lambda r: (hash((r["id"] * 0x9E3779B97F4A7C15) & 0xFFFFFFFF), r["id"]))
    return fit([words_of(r["text"]) for r in rows], [r["toxic"] for r in rows], prior)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs``, with or without the text, with ``out double``: whole texts scored, null and empty ones too."""
    kept = [f for f in docs.schema if f.name != out and (keep_text or f.name != text)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` double"])
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = sent.value
        logit: dict[str, float] = {}
        for batch in batches:
            scores: list[float] = []
            texts = batch.column(text)
            at = 0
            while at < len(texts):
                held, size = [], 0
                while at < len(texts) and size < 1 << 18:
                    x = texts[at].as_py() or ""
                    held.append(words_of(x))
                    size += len(x)
                    at += 1
                new = list(set().union(*held) - logit.keys())
                if new:
                    if len(logit) + len(new) > CACHED:
                        logit.clear()
                        new = list(set().union(*held))
                    logit.update(zip(new, model.word_logits(new).tolist(), strict=True))
                for words in held:
                    z = model.worst(np.fromiter(map(logit.__getitem__, words), np.float64, len(words)))
                    scores.append(model.score(z, len(words)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(scores, pa.float64())], [*(f.name for f in kept), out])

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``: one row per row of ``docs``.

    ``labels(doc_id, toxic)`` teach, but for held-out ids; null labels and values but 0 and 1 are left out,
    and of several labels of an id the largest counts. Without both classes every score is the share
    of label 1. Null texts count as empty; rows with a null id are not held out. Repeated rows
    score alike. An empty table gives an empty result. No other column is an input of a score.
    """
    model = train(docs, labels, doc_id, text)
    scored = score(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score at least ``threshold``.

    Null and empty texts, repeated rows and null ids are scored as in :func:`score_documents`; other columns pass
    through whatever their names; an empty table gives an empty one.
    """
    out = free_name(docs, "_score")
    return score(docs, train(docs, labels, doc_id, text), text, out, keep_text=True).filter(F.col(out) < threshold).select(*docs.columns)
