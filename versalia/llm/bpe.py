"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For each prefix of a piece there is exactly one token that can come last in its encoding: the
vocabulary entry that is a suffix of the prefix and may follow the last token of the
prefix that remains. An automaton over the vocabulary names all suffixes at each place; the pair
test asks whether merging would ever have joined across the boundary; back-pointers from
the end give the ids. Pieces are those that the byte-level pre-tokenizer makes.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: The pre-tokenizer's pattern, a fixed value of the format.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Strings that each half of a cache holds, and tested pairs that a worker keeps.
CACHED, TESTED = 240_000, 400_000
LONGEST_CACHED = 64
#: Marks that end a word as a piece of their own.
COMMON_ENDS = (".", ",", ";", ":", "?", "!")
#: Token ids a worker holds before it hands a batch on.
IDS_AT_ONCE = 1 << 19


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, inverted."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


class Vocabulary:
    """Ids and bytes of a tokenizer file (``Tokenizer.save`` JSON, byte-level BPE without normalizer)."""

    def __init__(self, raw: bytes) -> None:
        file = json.loads(raw)
        model = file["model"]
        if model["type"] != "BPE" or file.get("normalizer") or file["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level BPE without a normalizer or prefix space is supported")
        alphabet = byte_alphabet()
        self.special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        self.bytes = {i: bytes(map(alphabet.__getitem__, t)) for t, i in model["vocab"].items() if t not in self.special}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ids, self.alphabet = model["vocab"], alphabet


class Encoder:
    """Encodes pieces of text; one per worker process."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick
        import numpy as np
        import regex

        self.pieces = regex.compile(PIECES).findall
        self.special = vocabulary.special
        self.marks = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        # own numbers: bytes 0..255, then merged tokens in the order of their merges
        number = {t: b for t, b in vocabulary.alphabet.items() if t in vocabulary.ids}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        names = [""] * 256
        for t, b in number.items():
            names[b] = t
        for left, right in vocabulary.merges:
            a, b = number[left], number[right]
            self.joined[a, b] = number[left + right] = len(self.halves)
            self.halves.append((a, b))
            names.append(left + right)
        self.size = [1] * 256
        for a, b in self.halves[256:]:
            self.size.append(self.size[a] + self.size[b])
        self.id = [np.int32(vocabulary.ids[t]).tobytes() if t else b"" for t in names]
        self.suffixes = ahocorasick.Automaton()
        for t, n in number.items():
            self.suffixes.add_word("".join(chr(vocabulary.alphabet[c]) for c in t), (n, self.size[n]))
        self.suffixes.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.cache = _Cache(self.encode_piece, CACHED // 4)
        self.spaced, self.lined = (_Cache(lambda x, lead=lead: self.encode_chunk(lead, x), most) for lead, most in ((" ", CACHED), ("\n", CACHED // 4)))
        self.open = regex.compile(r"\s").match
        self.ends = regex.compile(r"\s\Z").search

    def fits(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay apart: merging never joins across their boundary.

        Goes back in time from the finished tokens, undoing the later merge of the two next to
        the boundary; a pair that merges before its half is taken up elsewhere joins them.
        Of equal merges the left one comes first.
        """
        taken = len(self.halves) + 1
        while True:
            if self.joined.get((left, right), taken) < taken:
                return False
            if left > right and left > 255:
                taken, left = left, self.halves[left][1]
            elif right > 255:
                taken, right = right + 1, self.halves[right][0]
            else:
                return True

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece, as int32 in native order."""
        text = piece if piece.isascii() else piece.encode().decode("latin-1")
        last = [-1] * (len(text) + 1)
        last[0] = 0
        pairs, size = self.pairs, self.size
        for end, (token, length) in self.suffixes.iter(text):
            end += 1
            if last[end] >= 0:  # longer matches come first
                continue
            if end > length:
                pair = last[end - length] << 20 | token
                fit = pairs.get(pair)
                if fit is None:
                    if len(pairs) >= TESTED:
                        pairs.clear()
                    fit = pairs[pair] = self.fits(pair >> 20, token)
                if not fit:
                    continue
            last[end] = token
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= size[last[at]]
        out.reverse()
        return b"".join(map(self.id.__getitem__, out))

    def encode_chunk(self, lead: str, rest: str) -> bytes:
        """Ids of ``lead`` (one space or line feed) and what follows up to the next.

        The pre-tokenizer always cuts where white space follows anything else, so such chunks can be
        encoded apart; if ``rest`` is empty or has white space at an end, they can't.
        """
        if rest.isalpha():
            return self.encode_piece(lead + rest) if lead == " " else self.cache[lead] + self.cache[rest]
        if lead == " " and rest[-1:] in COMMON_ENDS and rest[:-1].isalpha():
            return self.spaced[rest[:-1]] + self.cache[rest[-1]]
        if not rest or self.open(rest) or self.ends(rest):
            raise _Runs
        return b"".join(map(self.cache.__getitem__, self.pieces(lead + rest)))

    def encode_plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        lines = text.split("\n")
        first, *rest = lines[0].split(" ")
        try:
            if self.ends(first):
                raise _Runs
            out = [*map(self.cache.__getitem__, self.pieces(first)), *map(self.spaced.__getitem__, rest)]
            for line in lines[1:]:
                first, *rest = line.split(" ")
                out.append(self.lined[first])
                out += map(self.spaced.__getitem__, rest)
        except _Runs:
            out = map(self.cache.__getitem__, self.pieces(text))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as int32 in native order; strings of special tokens become those."""
        import numpy as np

        if not any(t in text for t in self.special):
            return self.encode_plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self.encode_plain(text[at : m.start()]), np.int32(self.special[m[0]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.encode_plain(text[at:])])


class _Runs(Exception):
    """White space runs: the text must be cut as a whole."""


class _Cache(dict):
    """Ids of short strings met lately: when it is full it becomes the older half, of which strings met again come back."""

    def __init__(self, make, most: int) -> None:
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.make(text)
        if len(text) <= LONGEST_CACHED:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Decoder:
    """Bytes of ids, gathered from one flat table. Ids that the vocabulary lacks give nothing."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import numpy as np

        top = max(vocabulary.bytes, default=-1) + 1
        self.size = np.zeros(top + 1, np.int64)
        for i, b in vocabulary.bytes.items():
            self.size[i] = len(b)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(vocabulary.bytes.get(i, b"") for i in range(top)), np.uint8)

    def decode(self, ids) -> str:
        """Text of an int array; bytes that aren't UTF-8 become U+FFFD."""
        import numpy as np

        parts = []
        for a in range(0, len(ids), 1 << 16):
            i = ids[a : a + (1 << 16)]
            i = np.where((i >= 0) & (i < len(self.size)), i, len(self.size) - 1)
            size = self.size[i]
            ends = np.cumsum(size)
            if len(ends) and ends[-1]:
                parts.append(self.flat[np.repeat(self.start[i] - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


_made: dict[tuple[str, type], object] = {}


def _worker(kind: type, raw: bytes):
    """The worker process's encoder or decoder of a tokenizer file."""
    key = hashlib.sha256(raw).hexdigest(), kind
    if key not in _made:
        _made[key] = kind(Vocabulary(raw))
    return _made[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _extended(df: DataFrame, drop: str | None, outs: dict[str, str], make) -> DataFrame:
    """``df`` without ``drop``, with the columns ``outs`` (name: type): ``make(batch)`` yields (rows, arrays) parts."""
    text_batches(df.sparkSession)
    kept = [f for f in df.schema if f.name != drop and f.name not in outs]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{k}` {v}" for k, v in outs.items())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = 0
            for n, arrays in make(batch):
                part = batch.slice(at, n)
                at += n
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *arrays], [*(f.name for f in kept), *outs])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep_text: bool = True, decoded: str | None = None) -> DataFrame:
    """``df`` with a column ``ids array<int>``: the encoding of ``text`` by the tokenizer file at ``path``.

    Whole texts are encoded; null and empty texts give no ids. Strings of special tokens in a text
    become those tokens, no others are added. With ``decoded``, a column of that name has the
    text that the ids decode to, made in the same pass. The file is read on the driver and sent
    to the workers (a few MB, whatever the input). Rows are handled one by one: repeated rows, ties
    and empty tables need no rule; other columns pass through, those named like an output are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(_read(path))

    def make(batch):
        import numpy as np
        import pyarrow as pa

        encoder = _worker(Encoder, sent.value)
        held, total = [], 0

        def part():
            ends = np.cumsum([0, *(len(b) // 4 for b in held)], dtype=np.int32)
            arrays = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(held), np.int32)))]
            if decoded:
                decoder = _worker(Decoder, sent.value)
                arrays.append(pa.array([decoder.decode(np.frombuffer(b, np.int32)) for b in held], pa.string()))
            return len(held), arrays

        for x in batch.column(text):
            held.append(encoder.encode(x.as_py() or ""))
            total += len(held[-1]) // 4
            if total >= IDS_AT_ONCE:
                yield part()
                held, total = [], 0
        if held:
            yield part()

    return _extended(df, None if keep_text else text, {ids: "array<int>"} | ({decoded: "string"} if decoded else {}), make)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """``df`` with a string column ``out``: the text that ``ids`` stands for, special tokens included.

    Null arrays and null or unknown ids give nothing.
    """
    sent = df.sparkSession.sparkContext.broadcast(_read(path))

    def make(batch):
        import numpy as np
        import pyarrow as pa

        decoder = _worker(Decoder, sent.value)
        texts = []
        for x in batch.column(ids):
            values = x.values
            texts.append("" if values is None else decoder.decode(np.asarray(values.fill_null(-1), dtype=np.int64)))
        yield len(texts), [pa.array(texts, pa.string())]

    return _extended(df, None if keep_ids else ids, {out: "string"}, make)


def ids_sha256(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
