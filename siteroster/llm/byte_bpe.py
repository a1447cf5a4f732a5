"""Byte-level BPE encoding and decoding through a sentencepiece model written from a rank file.

A rank file lists byte strings in the order of their merges. It is written out as a sentencepiece BPE
model: each byte becomes one letter, each byte string a piece with the score ``-rank``, and the
normaliser is the identity, so that sentencepiece merges exactly as the ranks say. Texts are cut into
pre-tokens by the pattern, each is encoded on its own, and ids are decoded by the inverse mapping.

NULL texts count as empty; an empty text has no ids. Repeated rows give repeated results. Texts are
encoded whole, whatever their length. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from itertools import chain, islice

import numpy as np
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteroster.llm.common import add_columns

#: Bytes become the letters from here on: one to one, none of them white space or special to sentencepiece.
FIRST_LETTER = 0x100
_LETTERS = {b: chr(FIRST_LETTER + b) for b in range(256)}
_CACHE_ROOM = 250_000


def read_ranks(content: bytes) -> list[bytes]:
    """Byte strings of a rank file (base64 and rank per line), in order of rank."""
    ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, content.splitlines()) if token}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    tokens = [ranks[i] for i in range(len(ranks))]
    if len({*tokens} & {bytes([b]) for b in range(256)}) < 256:
        raise ValueError("every single byte needs a rank")
    return tokens


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: varint, 32-bit float or bytes, by the type of the value."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def as_letters(data: bytes) -> str:
    return data.decode("latin-1").translate(_LETTERS)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """The serialised model: piece 0 is unknown, piece ``rank + 1`` is the token of that rank."""
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, as_letters(t).encode()) + _field(2, float(-rank)) for rank, t in enumerate(tokens)]
    no_control = 2 ** 64 - 1  # -1: the model has no begin, end or padding piece
    trainer = (_field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, no_control) + _field(42, no_control)
               + _field(43, no_control))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


def _trimmed(cache: dict[str, bytes], short: int = 8) -> dict[str, bytes]:
    """A cache that has outgrown its room keeps the short words, which mostly are the frequent ones."""
    if len(cache) <= _CACHE_ROOM:
        return cache
    kept = {w: v for w, v in cache.items() if len(w) <= short}
    return kept if len(kept) < _CACHE_ROOM // 2 else {}


class Codec:
    """Encoder and decoder of one vocabulary. Ids travel as little-endian unsigned 32-bit integers."""

    #: A space before white space or at the end: only then does a token cross a space.
    _crossing = re.compile(r" (?:\s|$)")

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        # a token that merging does not reach is still taken when it is a whole pre-token
        self.whole = {t: struct.pack("<I", rank) for rank, t in enumerate(tokens)
                      if len(t) > 1 and self.model.encode(as_letters(t)) != [rank + 1]}
        self.pre: dict[str, bytes] = {}  # ids of pre-tokens, and of words with the space before them
        self.words: dict[str, bytes] = {}

    def _learn(self, cuts: list[list[str]]) -> None:
        """Encode the pre-tokens that are new."""
        new = list(set(chain.from_iterable(cuts)) - self.pre.keys())
        letters = [as_letters(t.encode()) for t in new]
        for t, ids in zip(new, self.model.encode(letters, num_threads=1)):
            self.pre[t] = struct.pack(f"<{len(ids)}I", *[i - 1 for i in ids])
        if self.whole:
            self.pre.update((t, self.whole[t.encode()]) for t in new if t.encode() in self.whole)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. A space that stands before a visible character begins a pre-token, so
        words are cut and looked up one by one; other texts are cut by the pattern as a whole."""
        self.words, self.pre = _trimmed(self.words), _trimmed(self.pre)
        parts = [None if self._crossing.search(t) else t.split(" ") for t in texts]
        whole = {i: self.find(t) for i, t in enumerate(texts) if parts[i] is None}
        heads = {p[0]: self.find(p[0]) for p in parts if p}
        new = list(set().union(*[p[1:] for p in parts if p]) - self.words.keys())
        cut = [[" " + w] if w.isalpha() else self.find(" " + w) for w in new]
        self._learn([*whole.values(), *heads.values(), *cut])
        pre, words = self.pre.__getitem__, self.words.__getitem__
        self.words.update((w, b"".join(map(pre, c))) for w, c in zip(new, cut))
        out = []
        for i, p in enumerate(parts):
            if p is None:
                out.append(b"".join(map(pre, whole[i])))
            else:
                out.append(b"".join([*map(pre, heads[p[0]]), *map(words, islice(p, 1, None))]))
        return out

    def forget(self) -> None:
        self.words, self.pre = {}, {}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_open: dict[tuple, Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    """The codec of a file that every worker has; one per worker process."""
    if (path, pattern) not in _open:
        with open(path, "rb") as f:
            _open[path, pattern] = Codec(read_ranks(f.read()), pattern)
    return _open[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """Add the ids of each text as packed little-endian unsigned 32-bit integers, and their number.

    ``path`` is the rank file, installed at the same place on every worker.
    """
    def score(texts):
        codec = _codec(path, pattern)
        ids = codec.encode([t or "" for t in texts])
        return {name: ids, "n_tokens": [len(x) // 4 for x in ids]}
    return add_columns(df, text, f"{name} binary, n_tokens long", score, lambda: _codec(path, pattern).forget())


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the bytes that packed ids stand for; NULL ids count as none."""
    def score(packed):
        codec = _codec(path, pattern)
        return {name: [codec.decode(x or b"") for x in packed]}
    return add_columns(df, ids, f"{name} binary", score)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Digests of ``encode`` and ``decode`` in one pass: n_tokens, ids_sha256, decoded_sha256."""
    def score(texts):
        codec = _codec(path, pattern)
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids in codec.encode([t or "" for t in texts]):
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return out
    return add_columns(df, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", score,
                       lambda: _codec(path, pattern).forget())


def unpacked(column: str):
    """Packed ids as an array of integers."""
    hexed = F.hex(F.col(column))
    return F.transform(F.sequence(F.lit(0), F.octet_length(column) / 4 - 1), lambda i: F.conv(
        F.concat(*[F.substring(hexed, i.cast("int") * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("int"))
