"""Token-ID output as directly addressable codes: random access to any token of a shard without block decoding.

An id is split into 8-bit chunks. Level 0 holds the lowest chunk of every id; a bitmap says which ids continue, and
the k-th that continues has its next chunk at place k of level 1, and so on. A rank directory (ones before each 512
bits) makes that k one table entry and at most eight popcounts.

A shard file, little-endian: magic SDAC, version, levels, 0 (4 x u32 with the magic), documents, tokens, sections
(3 x u64), then for each section its offset and bytes (2 x u64), then the sections, 8-byte aligned: document ids
(i64), null flags of ids (u8), first token of each document and the end (u64), then chunks (u8), bitmap (u64) and
ranks (u64) of each level. Shards follow one another in ascending document id, null ids first, equal ids by a hash of their
text, so that rows of one id can be many tasks'; a manifest of one row a shard gives their order and token totals.

Null texts are encoded as empty: the end id alone. Repeated rows are repeated documents. An empty table gives no
shard and no row. Only the id and text columns are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.llm.token_count import PieceTable, by_bytes, drops_spaces, library, utf8
from sedimenta.session import scratch

MAGIC = b"SDAC"
BLOCK = 512
END_ID = 1
SHARD_TOKENS = 4 << 20


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, ranks) of each level of uint32 ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.zeros(-(-len(rest) // BLOCK) * BLOCK, bool)
        bits[: len(rest)] = more
        bitmap = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.bitwise_count(bitmap).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint64)
        ranks = np.concatenate([[np.uint64(0)], np.cumsum(ones, dtype=np.uint64)])
        levels.append(((rest & 255).astype(np.uint8), bitmap, ranks))
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            return levels


def shard_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The content of a shard file."""
    levels = encode_levels(ids)
    sections = [
        np.array([0 if d is None else d for d in doc_ids], "<i8"),
        np.array([d is None for d in doc_ids], np.uint8),
        np.concatenate([[0], np.cumsum(lengths)]).astype("<u8"),
        *(part for level in levels for part in level),
    ]
    head = 16 + 24 + 16 * len(sections)
    place, table, body = head, [], []
    for section in sections:
        raw = section.tobytes()
        table.append((place, len(raw)))
        body += [raw, b"\0" * (-len(raw) % 8)]
        place += len(raw) + -len(raw) % 8
    return b"".join([MAGIC, struct.pack("<III", 1, len(levels), 0), struct.pack("<QQQ", len(doc_ids), len(ids), len(sections)), *(struct.pack("<QQ", *x) for x in table), *body])


class Shard:
    """A shard read through any random-access source with read_at(bytes, offset); only what a call needs is read."""

    def __init__(self, source):
        self.source = source
        magic, version, self.levels, _, self.n_docs, self.n_tokens, n = struct.unpack("<4sIIIQQQ", source.read_at(40, 0))
        if magic != MAGIC or version != 1:
            raise ValueError("not a shard of token ids")
        flat = struct.unpack(f"<{2 * n}Q", source.read_at(16 * n, 40))
        self.sections = list(zip(flat[::2], flat[1::2], strict=True))

    def _part(self, section: int, kind: str, first: int = 0, count: int | None = None) -> np.ndarray:
        offset, size = self.sections[section]
        width = np.dtype(kind).itemsize
        if count is None:
            count = size // width - first
        return np.frombuffer(self.source.read_at(count * width, offset + first * width), kind)

    def token(self, i: int) -> int:
        """Token i: for each level one chunk, one rank entry and one bitmap block."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = 0
        for level in range(self.levels):
            out |= int(self._part(3 + 3 * level, "u1", i, 1)[0]) << 8 * level
            block, bit = divmod(i, BLOCK)
            words = self._part(4 + 3 * level, "<u8", block * BLOCK // 64, BLOCK // 64)
            word, at = divmod(bit, 64)
            if not int(words[word]) >> at & 1:
                break
            before = int(np.bitwise_count(words[:word]).sum()) + (int(words[word]) & (1 << at) - 1).bit_count()
            i = int(self._part(5 + 3 * level, "<u8", block, 1)[0]) + before
        return out

    def all(self) -> np.ndarray:
        """Every token, level by level from the deepest."""
        deeper = np.empty(0, np.uint32)
        for level in reversed(range(self.levels)):
            ids = self._part(3 + 3 * level, "u1").astype(np.uint32)
            bits = np.unpackbits(self._part(4 + 3 * level, "u1"), bitorder="little")[: len(ids)].astype(bool)
            ids[bits] |= deeper << np.uint32(8)
            deeper = ids
        return deeper

    def docs(self) -> tuple[list[int | None], np.ndarray]:
        """Document ids, and the first token of each and the end."""
        nulls = self._part(1, "u1")
        return [None if n else int(d) for d, n in zip(self._part(0, "<i8"), nulls, strict=True)], self._part(2, "<u8").astype(np.int64)


def _encoder(path: str):
    """A function from a column of texts to runs of rows: first row, uint32 ids, offset of each row's ids and the end."""
    if drops_spaces(path):
        return PieceTable(path).encoded
    model = library(path)

    def encode(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        row = 0
        for run in by_bytes(utf8(column)):
            made = [e.ids for e in model.encode_batch_fast([t.decode() for t in run], add_special_tokens=False)]
            yield row, np.concatenate([np.empty(0, np.uint32), *(np.array(x, np.uint32) for x in made)]), np.cumsum([0, *map(len, made)])
            row += len(run)

    return encode


def write_shards(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode docs into shard files below folder; returns the manifest (part, seq, path, n_docs, n_tokens), written there too.

    One range shuffle orders the documents. Each attempt of a task writes files of its own names and only the
    attempt that succeeds is in the manifest, so lost executors leave nothing half-written in it.
    """
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = _encoder(path), TaskContext.get().partitionId(), 0
        ids, lengths, chunks, held = [], [], [], 0

        def close():
            nonlocal held
            chunks.append(end)
            lengths[-1] += 1
            held += lengths[-1]

        def flush():
            nonlocal ids, lengths, chunks, held, seq
            tokens = np.concatenate(chunks)
            name = f"{folder}/shards/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex[:8]}.dac"
            fs, at = pa.fs.FileSystem.from_uri(name)
            fs.create_dir(at.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(at) as f:
                f.write(shard_bytes(ids, lengths, tokens))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [name], "n_docs": [len(ids)], "n_tokens": [len(tokens)]})
            ids, lengths, chunks, held, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            names, at = batch.column(0).to_pylist(), -1
            for row, tokens, edges in encode(batch.column(1)):
                for k in range(len(edges) - 1):
                    if row + k != at:  # else the rest of a long text
                        if at >= 0:
                            close()
                        if held >= shard_tokens:
                            yield flush()
                        at = row + k
                        ids.append(names[at])
                        lengths.append(0)
                    chunks.append(tokens[edges[k] : edges[k + 1]])
                    lengths[-1] += int(edges[k + 1] - edges[k])
            if at >= 0:
                close()
        if ids:
            yield flush()

    text = F.col(text_col).cast("string")
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h")).repartitionByRange("id", "h").sortWithinPartitions("id", "h")
    ordered.select("id", "text").mapInArrow(run, "part int, seq int, path string, n_docs long, n_tokens long").write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the shards of folder, from the files alone.

    The only rows met in one place are the totals of the partitions that wrote the manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = pa.fs.FileSystem.from_uri(name)
                with fs.open_input_file(at) as f:
                    shard = Shard(f)
                    (docs, edges), tokens = shard.docs(), shard.all().astype("<u4")
                sums = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(edges[:-1] + first), pa.array(np.diff(edges)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    manifest = spark.read.parquet(f"{folder}/manifest")
    above = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", above(Window.orderBy("part")).alias("before"))
    inside = manifest.select("path", "part", above(Window.partitionBy("part").orderBy("seq")).alias("inside"))
    placed = inside.join(parts, "part").select("path", (F.col("before") + F.col("inside")).cast("long").alias("first"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(parts, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_index(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Write the shards of docs and read them back: the index of documents with checksums of their ids."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "dac")
    write_shards(docs, path, folder)
    return read_documents(spark, folder)
