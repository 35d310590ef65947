"""Token ids in files of fixed-width bit fields.

Each id takes ``width`` bits, the fewest that hold every id of the vocabulary.  A
file holds one range of documents in ascending id order::

    blocks   BLOCK ids each (the last may be shorter), packed with numpy, little bit first
    footer   document ids (int64, with a null flag), ids per document (uint64),
             byte offset of each block (uint64), then a fixed tail: the counts,
             the width, BLOCK and a magic number

Block offsets make access random: ``PackedFile.ids(start, stop)`` reads and unpacks only
the blocks it needs.  A file appears under its final name in one move, so a task that
is run again replaces it by the same bytes.

Fixed meaning of edge cases: a null text is empty, a document without ids has the end
id only, null document ids come first, rows that share an id are ordered by their text
and all kept, an empty table makes no file.
"""

from __future__ import annotations

import io
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, new_folder, saved, small_batches

BLOCK = 4096
#: Ids after which a task goes on to a new file.
FILE_IDS = 1 << 26
MAGIC = b"BITIDS01"
TAIL = struct.Struct("<QQQIIIQ8s")  # ids, documents, blocks, width, block, spare, footer bytes, magic
#: Words, and pre-tokens, that a Python worker remembers the ids of; beyond it, it starts afresh.
REMEMBERED = 400_000


def width_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Fixed-width bit fields, least significant bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    """The first ``count`` ids of ``data``, as unsigned 32-bit integers."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^s3[an]://", "s3://", path)  # Hadoop's names of the scheme
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer:
    """Writes one file; holds a block of ids and the document lengths."""

    def __init__(self, path: str, width: int, attempt: str):
        self.system, self.path = file_system(path)
        self.temporary = f"{self.path}.{attempt}.tmp"
        self.system.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.system.open_output_stream(self.temporary)
        self.width, self.held, self.pending, self.ids = width, [], 0, 0
        self.offsets, self.documents, self.lengths, self.at = [], [], [], 0

    def add(self, document: int | None, ids: np.ndarray) -> None:
        self.documents.append(document)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.pending += len(ids)
        if self.pending >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        end = len(ids) if last else len(ids) - len(ids) % BLOCK
        for i in range(0, end, BLOCK):
            data = pack(ids[i:min(i + BLOCK, end)], self.width)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.ids += end
        self.held, self.pending = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        null = np.array([d is None for d in self.documents], np.uint8)
        footer = b"".join((
            np.array([d or 0 for d in self.documents], "<i8").tobytes(), null.tobytes(),
            np.array(self.lengths, "<u8").tobytes(), np.array([*self.offsets, self.at], "<u8").tobytes(),
        ))
        tail = TAIL.pack(self.ids, len(self.documents), len(self.offsets), self.width, BLOCK, 0, len(footer), MAGIC)
        self.out.write(footer + tail)
        self.out.close()
        self.system.move(self.temporary, self.path)


class PackedFile:
    """One file, read by blocks."""

    def __init__(self, path: str):
        system, place = file_system(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        tail = self._read(size - TAIL.size, TAIL.size)
        self.n_ids, n_docs, n_blocks, self.width, self.block, _, footer, magic = TAIL.unpack(tail)
        if magic != MAGIC:
            raise ValueError(f"{path} is not a file of packed ids")
        data = io.BytesIO(self._read(size - TAIL.size - footer, footer))
        ids, null = np.frombuffer(data.read(8 * n_docs), "<i8"), np.frombuffer(data.read(n_docs), np.uint8)
        self.documents = [None if n else int(d) for d, n in zip(ids, null)]
        self.lengths = np.frombuffer(data.read(8 * n_docs), "<u8").astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.offsets = np.frombuffer(data.read(8 * (n_blocks + 1)), "<u8").astype(np.int64)

    def _read(self, at: int, count: int) -> bytes:
        self.file.seek(at)
        return self.file.read(count)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, from the blocks that hold them."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self._read(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        held = min((last + 1) * self.block, self.n_ids) - first * self.block
        if held == (last + 1 - first) * self.block and self.block * self.width % 8 == 0 or first == last:
            found = unpack(data, held, self.width)
        else:  # a shorter last block
            cut = int(self.offsets[last] - self.offsets[first])
            whole = (last - first) * self.block
            found = np.concatenate([unpack(data[:cut], whole, self.width), unpack(data[cut:], held - whole, self.width)])
        return found[start - first * self.block:stop - first * self.block]

    def read(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Document id, first place in the file and ids, a run of documents at a time."""
        i, n = 0, len(self.documents)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + 64 * self.block)))
            begin = int(self.starts[i])
            run = self.ids(begin, int(self.starts[j - 1] + self.lengths[j - 1]))
            for k in range(i, j):
                at = int(self.starts[k]) - begin
                yield self.documents[k], int(self.starts[k]), run[at:at + int(self.lengths[k])]
            i = j

    def close(self) -> None:
        self.file.close()


#: Fixed values of the word tokenizer's pre-splitting, for texts whose characters all lie below U+0180:
#: its letters (in lower case), numbers and white space there, and its contractions.
LETTER = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f"
NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
SPACE = "\t-\r \u0085\u00a0"
SIMPLE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
#: Texts with another character, or with the one whose lower case is two characters, go to the library whole.
OTHER = "[^\x00-\u017f]|\u0130"


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable bytes as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Ids of texts by a tokenizers file whose model works on one pre-token at a time.

    The ids of words, cut at ASCII white space, and of their pre-tokens are
    remembered: the library's model encodes each distinct pre-token once, and
    words that the pre-splitting here does not cover, or that hold one of the
    file's added tokens, go to the library whole.  The results are those of the
    library as it loads the file, added tokens included.
    Results are packed little-endian unsigned 32-bit integers.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.pieces: dict[str, bytes] = {}
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        # an added token in a word is found by the library; one that reaches over white space needs the whole text
        self.wide = any(t.lstrip or t.rstrip or t.single_word or t.normalized or t.content.split() != [t.content] for t in added)
        self.other = re.compile("|".join([OTHER, *(re.escape(t.content) for t in added)]))
        self.simple = self._covered()

    def _covered(self) -> bool:
        """Whether the fixed pre-splitting agrees with the file's own on a probe."""
        probe = "It's ÉtÉ we'll x2³ a b !?... naïve\u0085¿QUÉ? Ǆǅ 3.5% ª\x1cb\x00"
        return self._pieces(probe) == self._whole(probe)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        written = piece.encode().decode("latin-1").translate(self.letters)
        value = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        return value

    def _pieces(self, text: str) -> bytes:
        known = self.pieces
        return b"".join([known.get(p) or self._piece(p) for p in SIMPLE.findall(text.lower())])

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        value = self[word] = self._whole(text) if not self.simple or self.other.search(text) else self._pieces(text)
        return value

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a text given as UTF-8; no token reaches over white space, so words are encoded each."""
        if not text:
            return b""
        if self.wide:
            return self._whole(text.decode())
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        return b"".join(map(self.__getitem__, text.split()))


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def write(df: DataFrame, tokenizer_file: str, path: str, end_id: int | None = None,
          key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all texts below ``path`` and return one row per file of some ``FILE_IDS`` ids at most, in order of the documents.

    Rows: ``path``, ``n_docs``, ``n_ids``, ``base`` (ids in all files before).  The texts are dealt out by
    ranges of (key, hash of the text), so a key that many rows share is no bottleneck.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    ordered = rows.repartitionByRange(F.col("k").asc_nulls_first(), F.xxhash64("t")).sortWithinPartitions(
        F.col("k").asc_nulls_first(), F.xxhash64("t"), "t")
    schema = "shard bigint, part bigint, path string, n_docs bigint, n_ids bigint"

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, part = encoder(tokenizer_file), None, 0
        width = width_for(max(enc.tokenizer.get_vocab_size(), (end_id or 0) + 1))
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        task = TaskContext.get()
        shard = task.partitionId()

        def closed() -> pa.RecordBatch:
            writer.close()
            data = [shard, part, name(), len(writer.documents), writer.ids]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in data], ["shard", "part", "path", "n_docs", "n_ids"])

        def name() -> str:
            return f"{path}/part-{shard:06d}-{part:04d}.ids"

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if writer is None:
                    writer = Writer(name(), width, str(task.taskAttemptId()))
                writer.add(k, np.frombuffer(enc.encode(t) + end, "<u4"))
                if writer.ids >= FILE_IDS:
                    yield closed()
                    writer, part = None, part + 1
        if writer is not None:
            yield closed()

    files = saved(ordered.mapInArrow(encode, schema), "packed-ids-files")
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(files: DataFrame, digest: bool = False) -> DataFrame:
    """The documents in the files that ``write`` returned, one file a task.

    Columns: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids`` (an array), or with
    ``digest`` the unsigned crc32 of the ids as little-endian 32-bit integers, ``ids_crc32``.
    """
    last = "ids_crc32 bigint" if digest else "ids array<bigint>"

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = PackedFile(row["path"])
                held: list[tuple] = []
                size = 0
                for k, at, ids in file.read():
                    value = zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int64)
                    held.append((k, row["base"] + at, len(ids), value))
                    size += 0 if digest else len(ids)
                    if len(held) >= 4096 or size >= 1 << 20:
                        yield table(held)
                        held, size = [], 0
                if held:
                    yield table(held)
                file.close()

    def table(held: list[tuple]) -> pa.RecordBatch:
        k, at, n, value = zip(*held)
        kind = pa.int64() if digest else pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(value, kind)],
            ["doc_id", "start", "n_tokens", last.split()[0]])

    dealt = files.select("path", "base").repartition(F.col("path"))
    return dealt.mapInArrow(load, f"doc_id bigint, start bigint, n_tokens bigint, {last}")


def round_trip(df: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """Write all documents to a new folder in the shared one, and digest them from the files."""
    files = write(df, tokenizer_file, new_folder(df.sparkSession, "packed-ids"), end_id)
    return read(saved(files, "packed-ids-index"), digest=True)
