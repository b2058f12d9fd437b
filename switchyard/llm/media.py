"""Media columns: content-addressed payloads in tar shards.

``store`` turns every payload into a media file (an 8-bit grey PNG, 64 samples
a row: lossless), and writes it as a member ``<sha256>.png`` of a tar shard.
Each task streams to shards of at most ``shard_bytes`` in the shared folder
(any store pyarrow.fs can address), under a temporary name that is moved to a
name derived from the shard's member digests; a retried or speculative task
writes the same bytes under the same name.  A row carries digest, shard,
offset and length.  Equal contents share one address: within a shard a payload
is written once, across shards the least (shard, offset) is everybody's.

``metadata`` fills columns by range reads of the first 33 bytes of a member
(signature and header chunk) and never touches the rest.  ``read_back`` fetches
whole members, checks their digest and computes features of the samples.

Defined results: a null text is empty; an empty payload is one row of 64 zero
samples; repeated rows share one address; a null doc_id is kept as it is; an
empty table stores nothing; very long texts are stored whole, a row of any
length in one member; other columns, whatever their names, are not read.
A task that fails takes its unfinished shard back; one that is killed outright
leaves a ``_writing-`` file, which no row refers to.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm import _common as C

WIDTH = 64
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed by the PNG format


def pad(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the row width."""
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """8-bit grey PNG of a padded payload, rows unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(first: bytes) -> dict:
    """Metadata from the first 33 bytes of a PNG."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR" or zlib.crc32(first[12:29]) != struct.unpack(">I", first[29:33])[0]:
        raise ValueError("not a PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", first[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour_type": colour}


def decode_png(data: bytes) -> bytes:
    """The samples of a grey 8-bit unfiltered PNG."""
    meta = read_header(data[:HEADER])
    at, body = HEADER, b""
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            body += part
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(meta["height"], meta["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return lines[:, 1:].tobytes()


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class ShardWriter:
    """Streams members to tar shards; each is moved in place when it is full."""

    def __init__(self, root: str, shard_bytes: int):
        self.fs, self.path = filesystem(root)
        self.limit, self.out = shard_bytes, None
        self.held: dict[str, tuple[int, int]] = {}

    def _open(self) -> None:
        import uuid

        self.temp = f"{self.path}/_writing-{uuid.uuid4().hex}"
        self.out, self.at, self.names = self.fs.open_output_stream(self.temp), 0, hashlib.sha256()
        self.held = {}

    def add(self, digest: str, data: bytes) -> tuple[int, int]:
        """Offset and length of the member's content in the current shard."""
        if self.out is None:
            self._open()
        if digest not in self.held:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + data + bytes(-len(data) % 512))
            self.held[digest] = (self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % 512
            self.names.update(digest.encode())
        return self.held[digest]

    @property
    def full(self) -> bool:
        return self.out is not None and self.at >= self.limit

    def close(self) -> str:
        """End the shard; its name."""
        from pyarrow.fs import FileType

        self.out.write(bytes(1024))
        self.out.close()
        self.out = None
        name = f"{self.names.hexdigest()}.tar"
        if self.fs.get_file_info(f"{self.path}/{name}").type == FileType.NotFound:
            self.fs.move(self.temp, f"{self.path}/{name}")
        else:  # an earlier attempt at these members got here: the same bytes
            self.fs.delete_file(self.temp)
        return name

    def abandon(self) -> None:
        """Take back a shard that was not ended."""
        if self.out is not None:
            self.out.close()
            self.out = None
            self.fs.delete_file(self.temp)


def store(docs: DataFrame, root: str, shard_bytes: int = 32_000_000, shard_rows: int = 50_000) -> DataFrame:
    """Writes all payloads; per row: doc_id, n_bytes, digest (binary SHA-256 of the file), shard, offset, length.

    A shard ends at ``shard_bytes``, or when it serves ``shard_rows`` rows: rows
    that repeat its contents add no bytes but wait for its name.  Materialised
    once, so that later reads never write again.
    """
    filesystem_, path = filesystem(root)
    filesystem_.create_dir(path, recursive=True)
    id_type = docs.schema["doc_id"].dataType

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, ids, waiting = ShardWriter(root, shard_bytes), [], []

        def flush() -> pa.RecordBatch:
            name = shards.close()
            n, digests, offsets, lengths = zip(*waiting, strict=True)
            columns = [pa.concat_arrays(ids), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array([name] * len(n)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
            ids.clear()
            waiting.clear()
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])

        try:
            for batch in (b.slice(lo, 128) for b in batches for lo in range(0, b.num_rows, 128)):
                for k, text in enumerate(batch.column(1).to_pylist()):
                    raw = text.encode("utf-8", "surrogatepass") if text else b""
                    data = encode_png(pad(raw))
                    digest = hashlib.sha256(data)
                    ids.append(batch.column(0).slice(k, 1))
                    waiting.append((len(raw), digest.digest(), *shards.add(digest.hexdigest(), data)))
                    if shards.full or len(waiting) >= shard_rows:
                        yield flush()
            if waiting:
                yield flush()
        finally:  # nothing is open unless the task fails or is stopped
            shards.abandon()

    return C.materialize(docs.select("doc_id", "text").mapInArrow(write, f"doc_id {id_type.simpleString()}, n_bytes long, digest binary, shard string, offset long, length long"), "media-rows")


def addresses(rows: DataFrame) -> DataFrame:
    """One address for every content: the least (shard, offset) it was written at."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("a")).select("digest", "a.*")


class ShardReader:
    """Range reads with the last shard kept open."""

    def __init__(self, root: str):
        self.fs, self.path = filesystem(root)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.path}/{shard}")
        return self.file.read_at(length, offset)


def metadata(contents: DataFrame, root: str) -> DataFrame:
    """Adds width, height, bit_depth and colour_type from header-only range reads."""
    names = ["width", "height", "bit_depth", "colour_type"]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = ShardReader(root)
        for b in batches:
            found = [read_header(reader.read(s, int(o), HEADER)) for s, o in zip(b["shard"], b["offset"], strict=True)]
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(found, columns=names).astype("int32")], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in contents.schema)
    return contents.mapInPandas(fill, fields + "".join(f", {n} int" for n in names))


def read_back(contents: DataFrame, root: str) -> DataFrame:
    """Per content: its address and what its stored bytes hold, digest checked."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = ShardReader(root)
        for b in batches:
            out = []
            for digest, shard, offset, length, width, height in zip(b["digest"], b["shard"], b["offset"], b["length"], b["width"], b["height"], strict=True):
                data = reader.read(shard, int(offset), int(length))
                if hashlib.sha256(data).digest() != bytes(digest):
                    raise ValueError(f"{shard}@{offset} does not hold {bytes(digest).hex()}")
                payload = decode_png(data)
                hist = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                p = hist[hist > 0] / len(payload)
                feature = f"png;{width}x{height};8;sum={int(hist @ np.arange(256))};top={int(hist.argmax())};entropy={-(p * np.log2(p)).sum() + 0.0:.4f}"
                out.append((digest, shard, offset, length, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-64:]), feature))
            yield pd.DataFrame(out, columns=["digest", "shard", "offset", "length", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    return contents.mapInPandas(fetch, "digest binary, shard string, offset long, length long, payload_bytes long, payload_sha256 binary, tail_crc32 long, feature string")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = C.new_path(spark, "shards")
    rows = store(C.table(spark, sf_dir, "documents").select("doc_id", "text"), root)
    # in shard order, so that a task reads few shards from front to back
    contents = addresses(rows).repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    found = C.materialize(read_back(metadata(contents, root), root), "features")
    hexed = lambda c: F.lower(F.hex(c))
    joined = C.spread_join(rows.select("doc_id", "n_bytes", "digest"), found, "digest", "doc_id")  # one content may be that of very many rows
    return joined.select("doc_id", "n_bytes", "payload_bytes", hexed("payload_sha256").alias("payload_sha256"), "tail_crc32", F.col("length").alias("media_bytes"), hexed("digest").alias("media_sha256"), "feature", "shard", "offset")
