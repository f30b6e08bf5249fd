"""Token ids in seekable files: independent zstandard frames, a document index and a seek table.

Layout of a shard (all integers little-endian):

* frames: each a zstandard frame of whole documents' ids (two or four bytes an id), about
  ``FRAME_BYTES`` raw or one longer document;
* a skippable frame with the document index: ids, lengths and frames, compressed;
* a skippable frame with the seek table of the public seekable layout: for each frame its
  compressed size, raw size and checksum (low half of XXH64 of the raw bytes), then the number of
  frames, a descriptor byte and the magic number. The index counts as the last entry.

A reader takes the last bytes, then the seek table and the index, then only the frames of the
documents it wants, each held against its checksum.

Files are written under a name of the attempt and renamed, so a task that runs twice or is lost
half-way leaves one whole shard. ``pyarrow.fs`` reaches the folder by its URI.

Defined results: null and empty texts have the end id alone; documents come in ascending doc_id,
null ids first, equal ids by text; an empty table gives no shards and no rows; columns besides
doc_id and text take no part.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_path, partitions, settle

FRAME_BYTES = 1 << 18
SHARD_BYTES = 1 << 28
SKIPPABLE, SEEKABLE, TABLE_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX_MAGIC = 0x184D2A5D
MANIFEST = "shard int, file string, docs long, tokens long, bytes long"
MOST_WORDS = 600_000

#: Texts of these characters alone are normalised alike word by word and as a whole.
_PLAIN = re.compile("[\x20-\x7e\n\r\t¡-¬®-įı-ɏ–—‘’“”…€]*")

#: The steps of tokenizers that may be run word by word.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own.

    A tokenizer whose normaliser lowers case and folds white space, and whose first step never joins
    text across white space, gives a text the ids of its words one after another. Words repeat, so
    each task keeps what it has encoded (up to MOST_WORDS entries; later words are encoded anew).
    Texts with other characters or a special token's string go through the tokenizer whole, and so do
    all texts if the file's steps are not those of ``BY_WORD``.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        self.byte = dict(zip(keep + rest, map(chr, keep + [256 + i for i in range(len(rest))]), strict=True))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        own = json.loads(self.whole.to_str())
        self.by_word = {k: own[k] for k in ("normalizer", "pre_tokenizer", "post_processor")} == BY_WORD and not own["model"].get("dropout")

    def piece(self, text: str) -> bytes:
        mapped = text if text.isascii() else "".join(self.byte[b] for b in text.encode())
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def word(self, text: str) -> bytes:
        if text.isascii() and text.isalpha():
            found = self.piece(text)
        else:
            found = b"".join([self.known.get(p) or self.piece(p) for p in self.pieces(text)])
        if len(self.known) < MOST_WORDS:
            self.known[text] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_word or _PLAIN.fullmatch(text) is None or any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        known, word = self.known, self.word
        return b"".join([known.get(w) or word(w) for w in text.lower().split()])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _skippable(magic: int, payload: bytes) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


class ShardWriter:
    """Appends documents to an open binary file."""

    def __init__(self, out, width: int, level: int = 3):
        self.out, self.width, self.pack = out, width, zstandard.ZstdCompressor(level=level)
        self.raw: list[bytes] = []
        self.size = self.bytes = self.tokens = 0
        self.seek: list[tuple[int, int, int]] = []
        self.ids, self.null, self.lengths, self.frames = array("q"), bytearray(), array("Q"), array("I")

    def add(self, doc_id: int | None, ids: bytes) -> None:
        cell = ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        if self.raw and self.size + len(cell) > FRAME_BYTES:
            self.flush()
        self.raw.append(cell)
        self.size += len(cell)
        self.ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.lengths.append(len(ids) // 4)
        self.frames.append(len(self.seek))
        self.tokens += len(ids) // 4

    def _put(self, raw: bytes, wrap: Callable[[bytes], bytes] = bytes) -> None:
        cell = wrap(self.pack.compress(raw))
        self.out.write(cell)
        self.bytes += len(cell)
        self.seek.append((len(cell), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def flush(self) -> None:
        if self.raw:
            self._put(b"".join(self.raw))
            self.raw, self.size = [], 0

    def close(self) -> None:
        self.flush()
        head = struct.pack("<QB", len(self.ids), self.width)
        self._put(head + self.ids.tobytes() + bytes(self.null) + self.lengths.tobytes() + self.frames.tobytes(), lambda x: _skippable(INDEX_MAGIC, x))
        rows = b"".join(struct.pack("<III", *x) for x in self.seek)
        table = _skippable(SKIPPABLE, rows + struct.pack("<IBI", len(self.seek), TABLE_FLAG, SEEKABLE))
        self.out.write(table)
        self.bytes += len(table)


class ShardReader:
    """Random access to a shard through a seekable binary file."""

    def __init__(self, source):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.size()
        count, flag, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE or flag != TABLE_FLAG:
            raise ValueError("not a shard of token frames")
        rows = np.frombuffer(self._read(size - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3)
        self.sizes, self.raw_sizes, self.sums = rows[:, 0].tolist(), rows[:, 1].tolist(), rows[:, 2].tolist()
        self.at = np.concatenate([[0], np.cumsum(rows[:, 0], dtype=np.int64)]).tolist()
        raw = self._frame(count - 1, 8)
        n, self.width = struct.unpack_from("<QB", raw)
        self.ids = np.frombuffer(raw, "<i8", n, 9)
        self.null = np.frombuffer(raw, np.uint8, n, 9 + 8 * n).astype(bool)
        self.lengths = np.frombuffer(raw, "<u8", n, 9 + 9 * n).astype(np.int64)
        self.frames = np.frombuffer(raw, "<u4", n, 9 + 17 * n)
        ends = np.cumsum(self.lengths)
        self.starts = ends - self.lengths

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _frame(self, k: int, skip: int = 0) -> bytes:
        raw = self.unpack.decompress(self._read(self.at[k] + skip, self.sizes[k] - skip), max_output_size=self.raw_sizes[k])
        if len(raw) != self.raw_sizes[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} does not match its checksum")
        return raw

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in this shard, its ids); only the frames of wanted ids are read."""
        pick = np.arange(self.ids.size) if wanted is None else np.flatnonzero(np.isin(self.ids, np.fromiter(wanted, np.int64)) & ~self.null)
        last, raw, base = -1, b"", 0
        for i in pick.tolist():
            if (k := int(self.frames[i])) != last:
                last, raw = k, self._frame(k)
                base = int(self.starts[np.searchsorted(self.frames, k)])
            at = (int(self.starts[i]) - base) * self.width
            ids = np.frombuffer(raw, f"<u{self.width}", int(self.lengths[i]), at).astype("<u4")
            yield None if self.null[i] else int(self.ids[i]), int(self.starts[i]), ids


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def _write(folder: str, path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer, docs = TaskContext.get(), None, 0
        own = encoder(path)
        end = struct.pack("<I", end_id)
        name = f"shard-{task.partitionId():08d}.tok"
        fs, at = _open(folder)
        draft = f"{at}/.{name}.{task.taskAttemptId()}"
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    writer = ShardWriter(fs.open_output_stream(draft, compression=None), 2 if max(own.whole.get_vocab_size(), end_id + 1) <= 65536 else 4)
                writer.add(doc_id, own.encode(text.as_py() or "") + end)
                docs += 1
        if writer is not None:
            writer.close()
            writer.out.close()
            if fs.get_file_info(f"{at}/{name}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{at}/{name}")  # an earlier attempt's; not every store moves onto a file
            fs.move(draft, f"{at}/{name}")
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "file": name, "docs": docs, "tokens": writer.tokens, "bytes": writer.bytes}], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes all documents in ascending doc_id; gives the folder and its manifest, a row a shard of about SHARD_BYTES of text."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    fs, at = _open(folder)
    fs.create_dir(at, recursive=True)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(partitions(docs.sparkSession), -(-size // SHARD_BYTES))
    ordered = own.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return folder, settle(ordered.mapInArrow(_write(folder, tokenizer_path, end_id), MANIFEST), "manifest")


def read_tokens(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{at}/{row['file']}") as source:
                    found = [(i, row["before"] + start, ids.size, zlib.crc32(ids.tobytes())) for i, start, ids in ShardReader(source).documents()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    # A task a shard: the number is stated, or so few rows would be joined into one task. Ranges do not meet as hashes do.
    spread = manifest.withColumn("before", before).repartitionByRange(max(1, manifest.count()), "shard")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(folder: str, manifest: DataFrame, wanted: list[int]) -> DataFrame:
    """(doc_id, ids) of a stated list of documents; other frames are not decompressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{at}/{row['file']}") as source:
                    found = list(ShardReader(source).documents(wanted))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[2].tolist() for x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return manifest.mapInArrow(run, "doc_id long, ids array<long>")
