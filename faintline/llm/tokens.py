"""Token ids in seekable files: independent zstandard frames, an index of documents, a trailing seek table.

A file holds, in this order: data frames (zstandard, each on its own), one skippable frame with the index of
documents, and one skippable frame with the seek table of the public zstd seekable format (per frame: compressed
size, size, and the low 32 bits of XXH64 of its content). A reader takes the seek table from the end of the file,
then the index, then only the frames of the documents asked for.

Files are written by tasks into the shared folder; a manifest, committed by Spark, names those of the attempts
that counted, so a lost executor leaves at worst a file that nothing reads.

Defined results: null text is empty and gives the end id alone; rows are ordered by id, null ids first, ties by
text; a long text spans several frames; an empty table gives no files; other columns are not written. Text that
holds a special token's string is encoded as the tokenizers library does by default.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faintline.llm.common import slices

# Fixed values of the seekable format and of the split rule that the fast way below covers.
_SKIP_SEEK, _SKIP_INDEX, _SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_FRAME = 1 << 18  # bytes of a frame before compression
_WORDS = 150_000  # words whose ids a worker remembers at once

_LATIN = [chr(c) for c in range(0x250) if c != 0x130]
_L = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "L")
_N = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "N")
_WORD = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: What the fast way leaves to the library: rarer characters, and strings of special tokens.
_RARE = re.compile(r"[^\t\n\r\x20-\x7e\xa0-įı-ɏ‐-‧‰-⁞€]|<\|")


class _Known(dict):
    """Ids of words, as bytes; each word is split once by the tokenizer's own model."""

    def __init__(self, model) -> None:
        super().__init__()
        self.model = model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _WORDS:
            self.clear()
        ids = [t.id for t in self.model.tokenize(word.encode().decode("latin1").translate(self.byte))]
        self[word] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


class Encoder:
    """Ids as little-endian 32-bit bytes. For lower-casing word tokenizers whole words are looked up, not encoded anew."""

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.end = struct.pack("<I", end_id)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        steps = [n["type"] for n in (kind["normalizer"] or {}).get("normalizers", [])]
        split = (kind["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.fast = steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == _SPLIT and kind["model"]["end_of_word_suffix"] == "</w>"
        self.known = _Known(self.whole.model)
        self.small = self.whole.get_vocab_size() <= 1 << 16 and end_id < 1 << 16

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if self.fast and not _RARE.search(text):
            return b"".join(map(self.known.__getitem__, _WORD.findall(text.lower()))) + self.end
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.end


@functools.lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


class Writer:
    """Writes one file; documents in order."""

    def __init__(self, sink, width: int) -> None:
        self.sink, self.width = sink, width
        self.pack = zstandard.ZstdCompressor(level=3)
        self.open, self.entries, self.docs = bytearray(), [], []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.open += ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        while len(self.open) >= _FRAME:
            self._frame(bytes(self.open[:_FRAME]))
            del self.open[:_FRAME]

    def _write(self, data: bytes, raw: int, check: int) -> None:
        self.sink.write(data)
        self.entries.append((len(data), raw, check))
        self.size += len(data)

    def _frame(self, raw: bytes) -> None:
        self._write(self.pack.compress(raw), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)

    def close(self) -> None:
        if self.open:
            self._frame(bytes(self.open))
        has = np.array([d is not None for d, _ in self.docs], "u1")
        index = self.pack.compress(has.tobytes() + np.array([d or 0 for d, _ in self.docs], "<i8").tobytes() + np.array([n for _, n in self.docs], "<i8").tobytes())
        body = struct.pack("<BQ", self.width, len(self.docs)) + index
        self._write(struct.pack("<II", _SKIP_INDEX, len(body)) + body, 0, 0)
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), 128, _SEEK_MAGIC)
        self.sink.write(struct.pack("<II", _SKIP_SEEK, len(table)) + table)
        self.size += 8 + len(table)


class Reader:
    """Reads documents of one file; only the frames that hold them are fetched and decompressed."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != _SEEK_MAGIC or flags != 128:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(source.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.size, self.raw, self.check = table.T
        self.at, self.raw_at = np.cumsum(self.size) - self.size, np.cumsum(self.raw) - self.raw
        body = source.read_at(int(self.size[-1]), int(self.at[-1]))
        self.width, count = struct.unpack_from("<BQ", body, 8)
        index = zstandard.ZstdDecompressor().decompress(body[17:])
        self.has = np.frombuffer(index, "u1", count)
        self.ids = np.frombuffer(index, "<i8", count, count)
        self.counts = np.frombuffer(index, "<i8", count, 9 * count)
        self.starts = np.cumsum(self.counts) - self.counts
        self.unpack = zstandard.ZstdDecompressor()
        self.frames_read = 0
        self._last: tuple[int, bytes] = (-1, b"")

    def _frame(self, k: int) -> bytes:
        if self._last[0] != k:
            raw = self.unpack.decompress(self.source.read_at(int(self.size[k]), int(self.at[k])), max_output_size=int(self.raw[k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.check[k] or len(raw) != self.raw[k]:
                raise ValueError(f"frame {k} fails its checksum")
            self._last = (k, raw)
            self.frames_read += 1
        return self._last[1]

    def tokens(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file, as 32-bit numbers."""
        a, b = int(self.starts[i]) * self.width, int(self.starts[i] + self.counts[i]) * self.width
        k = int(np.searchsorted(self.raw_at[:-1], a, side="right")) - 1
        parts = []
        while a < b:
            frame, off = self._frame(k), a - int(self.raw_at[k])
            parts.append(frame[off : off + b - a])
            a += len(parts[-1])
            k += 1
        return np.frombuffer(b"".join(parts), f"<u{self.width}").astype("<u4")


def write(df: DataFrame, path: str, tokenizer: str, end_id: int, ident: str = "doc_id", text: str = "text") -> None:
    """Encode every text and write the files and their manifest below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end_id)
        files, root = pyarrow.fs.FileSystem.from_uri(path)
        files.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tokens.zst"
        sink = writer = None
        for batch in slices(batches, "text"):
            if writer is None:
                sink = files.open_output_stream(f"{root}/{name}", compression=None)
                writer = Writer(sink, 2 if encode.small else 4)
            for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                writer.add(doc, encode(t.as_py()))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "part": TaskContext.get().partitionId(), "n_docs": len(writer.docs), "n_tokens": sum(n for _, n in writer.docs), "n_bytes": writer.size}])

    rows = df.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "file string, part bigint, n_docs bigint, n_tokens bigint, n_bytes bigint").write.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str, wanted: Sequence[int] | None = None, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    ``wanted`` restricts to a list of ids that fits a task (as a broadcast would have to); the frames of other
    documents are not decompressed then.
    """
    chosen = None if wanted is None else np.array(sorted(set(wanted)), np.int64)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, root = pyarrow.fs.FileSystem.from_uri(path)
                with files.open_input_file(f"{root}/{row['file']}") as source:
                    reader = Reader(source)
                    rows = np.arange(len(reader.ids)) if chosen is None else np.flatnonzero(np.isin(reader.ids, chosen) & (reader.has == 1))
                    for c in range(0, len(rows), 1000):
                        out = []
                        for i in rows[c : c + 1000].tolist():
                            ids = reader.tokens(i)
                            one = {"doc_id": int(reader.ids[i]) if reader.has[i] else None, "start": row["start"] + int(reader.starts[i]), "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
                            out.append(one | ({"ids": ids.tolist()} if with_ids else {}))
                        yield pa.RecordBatch.from_pylist(out, schema)

    # one row per file: a running sum over them is small, whatever the input
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.parquet(f"{path}/manifest").select("file", "part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    return files.repartition(max(1, files.count()), "file").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)
