"""Byte-level BPE: encode texts by a local rank file, and decode ids to raw bytes.

Fixed meaning of edge cases: a null text counts as empty and has no ids; ids are
never special tokens; repeated rows are encoded each; columns of the input stay
unless they have an output column's name, which is then replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, without

#: Texts up to this many characters go to the encoder whole.
PIECE_CHARS = 20_000
#: A single space between two other non-space characters: every match of the
#: pre-splitting pattern that starts before it ends before it, so a text may be cut there.
BOUNDARY = regex.compile(r"(?<=\S) (?=\S)")

_encoders: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoder(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file (base64 token, rank), built once in a process."""
    key = (rank_file, pattern)
    if key not in _encoders:
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut at safe boundaries into pieces of about ``size`` characters, or longer where there is none."""
    at = 0
    while len(text) - at > size:
        cut = BOUNDARY.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str | None, size: int = PIECE_CHARS) -> list[int]:
    if not text:
        return []
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text, size):
        ids += enc.encode_ordinary(piece)
    return ids


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of each text, an array of integers."""
    small_batches(df.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        enc = encoder(rank_file, pattern)
        return pa.array((encode_text(enc, t) for t in texts.to_pylist()), pa.list_(pa.int32()))

    return without(df, out).withColumn(out, ids(F.col(text).cast("string"))) if out != text else df.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes of each array of ids; null where the array is null.  An id that has no token fails."""
    small_batches(df.sparkSession)

    @F.arrow_udf("binary")
    def raw(column: pa.Array) -> pa.Array:
        enc = encoder(rank_file, pattern)
        return pa.array((None if x is None else enc.decode_bytes(x) for x in column.to_pylist()), pa.binary())

    return without(df, out).withColumn(out, raw(ids))


def digests(df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "bpe") -> DataFrame:
    """``df`` with a struct: ``n_tokens``, sha256 of the decimal ids joined by spaces, sha256 of the decoded bytes.

    Encodes and decodes in one pass, so no ids leave the task.
    """
    small_batches(df.sparkSession)
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def digest(texts: pa.Array) -> pa.Array:
        enc = encoder(rank_file, pattern)
        rows = []
        for t in texts:
            ids = encode_text(enc, t.as_py())
            rows.append({
                "n_tokens": len(ids),
                "ids_sha256": hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                "decoded_sha256": hashlib.sha256(enc.decode_bytes(ids)).hexdigest(),
            })
        return pa.array(rows, kind)

    return without(df, out).withColumn(out, digest(F.col(text).cast("string"))) if out != text else df.withColumn(out, digest(F.col(text)))
