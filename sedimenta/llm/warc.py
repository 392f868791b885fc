"""WARC archives written from, and read into, a chunked record table.

The table has a row for each chunk of a record: record_id, chunk_no, data, and what is known so far - bytes_so_far and
sha1_so_far of the payload up to and with this chunk - and last. Payloads go through in pieces of CHUNK bytes both
ways: they are cut where they are read, chunk rows are joined with what is decided for their digest and reach the writer
in order; the reader streams a gzip member and gives a row for each piece, so neither holds a record.

Of the records with equal payloads of at least min_bytes bytes, that with the largest id is a response and the others
are revisits that name it; smaller ones are all responses. Rows that repeat the largest id are responses too. A record's
URN is that of its id and digest; of rows that repeat both, those after the first in a file have URNs of their own. Null
payloads are empty ones. Rows with a null id are written as responses, never referred to, and read back with a null
id. A null URL leaves the target out. An empty table gives an empty archive and no rows. Only the named columns are
read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.session import scratch

CHUNK = 1 << 18
FILE_BYTES = 64 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
EPOCH = "1970-01-01T00:00:00Z"
CHUNKS = "record_id long, uri string, record_type string, refers_to long, chunk_no int, data binary, bytes_so_far long, sha1_so_far string, last boolean, payload_bytes long, payload_digest string"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_urn(record_id: int | None, sha1: bytes, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'sedimenta:{record_id}:{sha1.hex()}:{salt}')}>"


def decided_chunks(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """record_id, uri, sha1 (hex), size, record_type, refers_to, chunk_no and data: records whole and in order in a partition.

    Payloads are cut into pieces where they are read; an empty one has one empty piece, and so has a revisit. The largest
    id of each digest is a partial aggregate; it's joined to the pieces on the digest, where adaptive execution can split a
    payload that very many records share, by the tasks that read it.
    """
    payload = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("record_id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    first = rows.where(F.col("record_id").isNotNull() & (F.col("size") >= min_bytes)).groupBy("sha1", "size").agg(F.max("record_id").alias("response"))
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / chunk) - 1).cast("int"))
    pieces = F.transform(numbers, lambda k: F.substring("payload", k * chunk + 1, F.lit(chunk)))
    chunks = rows.select("row", "record_id", "uri", "sha1", "size", F.posexplode(pieces).alias("chunk_no", "data"))
    joined = chunks.join(first, ["sha1", "size"], "left")
    again = F.coalesce(F.col("record_id") != F.col("response"), F.lit(False))
    kept = joined.where(~again | (F.col("chunk_no") == 0)).sortWithinPartitions("sha1", "size", "record_id", "row", "chunk_no")
    return kept.select("record_id", "uri", "sha1", "size", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("response")).alias("refers_to"), "chunk_no", F.when(again, F.lit(b"")).otherwise(F.col("data")).alias("data"))


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _clean(uri: str) -> str:
    return "".join(c for c in uri if c not in "\r\n\0")


class Writer:
    """Records of one file, a gzip member each, written piece by piece."""

    def __init__(self, stream):
        self.stream, self.size, self.member = stream, 0, None

    def _put(self, data: bytes) -> None:
        if data:
            self.stream.write(data)
            self.size += len(data)

    def begin(self, record_id: int | None, uri: str | None, kind: str, refers_to: int | None, sha1: bytes, size: int, salt: str = "") -> None:
        self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        fields = [("WARC-Type", kind), ("WARC-Record-ID", record_urn(record_id, sha1, salt)), ("WARC-Date", EPOCH), ("WARC-Payload-Digest", f"sha1:{base32(sha1)}"), ("X-Payload-Bytes", str(size))]
        if record_id is not None:
            fields.append(("X-Record-Number", str(record_id)))
        if uri is not None:
            fields.append(("WARC-Target-URI", _clean(uri)))
        if kind == "revisit":
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_urn(refers_to, sha1)), ("X-Refers-To-Number", str(refers_to))]
        body = 0 if kind == "revisit" else size
        fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(HTTP) + body))]
        self._put(self.member.compress(_header(fields) + HTTP))

    def data(self, piece: bytes) -> None:
        self._put(self.member.compress(piece))

    def end(self) -> None:
        self._put(self.member.compress(b"\r\n\r\n") + self.member.flush())
        self.member = None


def write_archives(chunks: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write chunk rows, records whole and in order within a partition, to .warc.gz files; returns and keeps the list of files.

    Files have names of their own for each attempt of a task, and the list has those of the attempts that succeeded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, stream, name, n, last = TaskContext.get().partitionId(), None, None, "", 0, None

        def close() -> pa.RecordBatch:
            stream.close()
            return pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([writer.size], pa.int64())})

        for batch in batches:
            ids, uris, shas, sizes, kinds, refers, numbers = (batch.column(i).to_pylist() for i in range(7))
            for i in range(len(batch)):
                if numbers[i] == 0:
                    if writer:
                        writer.end()
                        if writer.size >= file_bytes:
                            yield close()
                            writer = None
                    if not writer:
                        name = f"{folder}/archives/part-{part:06d}-{uuid.uuid4().hex[:10]}.warc.gz"
                        fs, at = pa.fs.FileSystem.from_uri(name)
                        fs.create_dir(at.rpartition("/")[0], recursive=True)
                        stream, n = fs.open_output_stream(at, compression=None), 0
                        writer = Writer(stream)
                    n += 1
                    again = ids[i] is None or last == (ids[i], shas[i])
                    writer.begin(ids[i], uris[i], kinds[i], refers[i], bytes.fromhex(shas[i]), sizes[i], f"{name}:{n}" if again else "")
                    last = ids[i], shas[i]
                writer.data(batch.column(7)[i].as_py())
        if writer:
            writer.end()
            yield close()

    chunks.mapInArrow(run, "path string, records long, bytes long").write.parquet(f"{folder}/files")
    return chunks.sparkSession.read.parquet(f"{folder}/files")


class Reader:
    """Records of a .warc.gz stream: headers, then the block in pieces, so no record is held whole."""

    def __init__(self, stream, piece: int = CHUNK):
        self.stream, self.piece, self.raw, self.buffer = stream, piece, b"", bytearray()
        self.gzip = zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if self.gzip.eof:
                self.raw = self.gzip.unused_data
                self.gzip = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.gzip.unconsumed_tail or self.stream.read(1 << 16)
                if not self.raw:
                    return False
            out = self.gzip.decompress(self.raw, self.piece)
            self.raw = self.gzip.unconsumed_tail
            if out:
                self.buffer += out
                return True
            if not self.raw and not self.gzip.eof and not (more := self.stream.read(1 << 16)):
                return False
            elif not self.raw and not self.gzip.eof:
                self.raw = more

    def _until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def records(self) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
        """(headers, pieces of the payload); the pieces have to be read before the next record."""
        while (head := self._until(b"\r\n\r\n")) is not None:
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            before = 0
            if fields["Content-Type"].startswith("application/http"):
                http = self._until(b"\r\n\r\n")
                before = len(http) + 4
            yield fields, self._pieces(int(fields["Content-Length"]) - before)
            while len(self.buffer) < 4 and self._more():
                pass
            del self.buffer[:4]

    def _pieces(self, left: int) -> Iterator[bytes]:
        while left:
            while len(self.buffer) < min(left, self.piece) and self._more():
                pass
            out = bytes(self.buffer[: min(left, self.piece)])
            if not out:
                raise EOFError("the archive ends inside a record")
            del self.buffer[: len(out)]
            left -= len(out)
            yield out


def read_chunks(spark: SparkSession, folder: str, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives listed in folder, with incremental digests.

    A revisit has one chunk without data, of the size and digest in its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, at = pa.fs.FileSystem.from_uri(name)
                with fs.open_input_stream(at, compression=None) as stream:
                    for fields, pieces in Reader(stream).records():
                        for row in _rows(fields, pieces, with_data):
                            rows.append(row)
                            held += len(row[5] or b"") + 200
                            if held > 8 << 20:
                                yield _batch(rows)
                                rows, held = [], 0
        if rows:
            yield _batch(rows)

    files = spark.read.parquet(f"{folder}/files").select("path")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(parts, "path").mapInArrow(run, CHUNKS)


def _rows(fields: dict[str, str], pieces: Iterator[bytes], with_data: bool) -> Iterator[tuple]:
    number, refers = fields.get("X-Record-Number"), fields.get("X-Refers-To-Number")
    base = (int(number) if number else None, fields.get("WARC-Target-URI"), fields["WARC-Type"], int(refers) if refers else None)
    if base[2] == "revisit":
        for _ in pieces:
            pass
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        yield *base, 0, b"", 0, base32(hashlib.sha1().digest()), True, int(fields["X-Payload-Bytes"]), digest
        return
    sha, size, k, held = hashlib.sha1(), 0, 0, next(pieces, b"")
    while True:
        after = next(pieces, None)
        sha.update(held)
        size += len(held)
        digest, last = base32(sha.digest()), after is None
        if last and f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"record {base[0]} doesn't match its digest")
        yield *base, k, held if with_data else None, size, digest, last, size if last else None, digest if last else None
        if last:
            return
        k, held = k + 1, after


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def archive_round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write pages to archives and read them back: payload_bytes, payload_digest, record_type and refers_to of each record."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    write_archives(decided_chunks(pages, id_col, uri_col, payload_col, min_bytes), folder)
    chunks = read_chunks(spark, folder, with_data=False)
    return chunks.where("last").select(F.col("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
