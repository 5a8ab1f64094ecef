"""Media columns: payloads in tar shards, addressed by content; rows carry digest, offset and length.

A payload is stored as a grey PNG of 8-bit samples, 64 wide. Every distinct payload is stored once, in a tar shard of the shared
folder, under its SHA-256; the manifest says where. Metadata columns are filled by range reads of the 33 header bytes alone,
features by range reads of one member; both are dealt by stripes of shards. A payload that only one document has is written by
the task that reads the document; only those that several may have are shuffled. A filter of all digests that occur more than
once tells them apart: it errs only towards the shuffle. Writers are tasks: a task that is run again writes new shards and only
those it returns count, so a lost executor leaves at most files that no manifest names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, narrow, release, scratch_path
from tessera.llm.sharing import digest_filter, join_by_key

WIDTH = 64
SHARD_BYTES = 256 << 20
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_LEVEL = 6
#: Bytes of a shard that one task reads at least, where they are that many.
STRIPE = 256 << 10
#: Shared payloads that a writer remembers to have handed on; beyond that it may hand one on again.
GIVEN = 100_000


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A grey image of 8-bit samples, 64 wide; each row after filter byte 0."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    flat = np.zeros((len(rows), WIDTH + 1), np.uint8)
    flat[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(flat.tobytes(), _LEVEL)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER bytes."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", first[16:25])


def from_png(data: bytes) -> bytes:
    width, height, _ = header(data)
    at, body = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a filter that this store does not write")
    return rows[:, 1:].tobytes()


def digest_of(text: Column | str) -> Column:
    """SHA-256 of a text's payload, as 32 bytes; a null text is an empty one."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    n = F.octet_length(text)
    pad = F.when(n == 0, F.lit(WIDTH)).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return F.unhex(F.sha2(F.concat(text, F.repeat(F.lit("\0"), pad)), 256))


class _Shards:
    """Tar shards that one task writes."""

    def __init__(self, store: str) -> None:
        from pyarrow import fs

        self.system, self.root = fs.FileSystem.from_uri(store)
        self.system.create_dir(self.root, recursive=True)
        self.out, self.name, self.offset = None, "", 0

    def add(self, key: bytes, media: bytes) -> tuple[bytes, str, int, int]:
        if self.out is None:
            self.name, self.offset = f"shard-{uuid.uuid4().hex}.tar", 0
            self.out = self.system.open_output_stream(f"{self.root}/{self.name}")
        info = tarfile.TarInfo(f"{key.hex()}.png")
        info.size = len(media)
        head = info.tobuf()
        self.out.write(head + media + bytes(-len(media) % 512))
        row = key, self.name, self.offset + len(head), len(media)
        self.offset += len(head) + len(media) + -len(media) % 512
        if self.offset >= SHARD_BYTES:
            self.close()
        return row

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


_PLACED = "digest binary, shard string, offset long, length long, media binary"


def _placed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["digest", "shard", "offset", "length", "media"])


def _encode(store: str, bits):
    """Payloads that may be shared come out with their media, without a place; the others are in a shard."""

    def run(batches):
        shards, given, shared = _Shards(store), set(), bits.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                payloads = [payload_of(t or b"") for t in batch.column(0).slice(at, 256).cast(pa.binary()).to_pylist()]
                keys = [hashlib.sha256(p).digest() for p in payloads]
                rows = []
                for key, p, maybe in zip(keys, payloads, shared.contains(keys), strict=True):
                    if not maybe:
                        rows.append((*shards.add(key, to_png(p)), None))
                    elif key not in given:  # copies in one partition go no further
                        if len(given) >= GIVEN:
                            given.clear()
                        given.add(key)
                        rows.append((key, None, None, None, to_png(p)))
                if rows:
                    yield _placed(rows)
        shards.close()

    return run


def _write(store: str):
    """Writes each payload of a stream that is sorted by digest once."""

    def run(batches):
        shards, last = _Shards(store), None
        for batch in batches:
            rows = []
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != last:
                    last = key
                    rows.append((*shards.add(key, media), None))
            if rows:
                yield _placed(rows)
        shards.close()

    return run


def store_texts(docs: DataFrame, store: str) -> DataFrame:
    """Stores each distinct payload of docs(text) once and returns the manifest (digest, n, shard, offset, length); n: how many rows
    have it."""
    docs = narrow(docs, text="string")
    digests = materialize(docs.groupBy(digest_of("text").alias("digest")).agg(F.count("*").alias("n")), "digests")
    often = docs.sparkSession.sparkContext.broadcast(digest_filter(digests.where("n > 1").select("digest")))
    first = materialize(docs.mapInArrow(_encode(store, often), _PLACED), "placed")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = first.where("shard is null").select("digest", "media").repartition(parts, "digest").sortWithinPartitions("digest").mapInArrow(_write(store), _PLACED)
    placed = first.where("shard is not null").unionByName(shared).drop("media")
    manifest = materialize(placed.join(digests, "digest"), "manifest")
    release(first)
    release(digests)
    return manifest


def _ranges(store: str, part: pa.RecordBatch, files: dict, size: int | None):
    """The bytes of each member, or its first `size`, by range reads. files: those that stay open, one at a time."""
    from pyarrow import fs

    for shard, offset, length in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length")), strict=True):
        if shard not in files:
            for f in files.values():
                f.close()
            files.clear()
            system, root = fs.FileSystem.from_uri(store)
            files[shard] = system.open_input_file(f"{root}/{shard}")
        files[shard].seek(offset)
        yield files[shard].read(min(length, size or length))


def _adding(store: str, size: int | None, compute, fields: list[tuple]):
    """Adds to each row the fields that compute() makes of its member's bytes."""

    def run(batches):
        files: dict = {}
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                rows = [compute(data) for data in _ranges(store, part, files, size)]
                more = [pa.array(c, kind) for c, (_, kind, _) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *(name for name, _, _ in fields)])
        for f in files.values():
            f.close()

    return run


def _with(rows: DataFrame, run, fields: list[tuple]) -> DataFrame:
    own = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(run, ", ".join([*own, *(f"{name} {kind}" for name, _, kind in fields)]))


_META = [(n, pa.int64(), "long") for n in ("width", "height", "depth")]
_FEATURES = [("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string")]


def by_stripe(manifest: DataFrame) -> DataFrame:
    """The manifest dealt by stripes of its shards, in the order of their bytes."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(parts, "shard", F.floor(F.col("offset") / STRIPE)).sortWithinPartitions("shard", "offset")


def read_headers(rows: DataFrame, store: str) -> DataFrame:
    """rows(shard, offset, length, ...) with the metadata columns width, height and depth, from HEADER bytes of each member."""
    return _with(rows, _adding(store, HEADER, header, _META), _META)


def read_features(rows: DataFrame, store: str) -> DataFrame:
    """rows(shard, offset, length, ...) with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature,
    computed from the stored bytes.

    feature: size and depth, mean, deviation and the counts of the samples in eight bands, and the number of zero samples.
    """

    def compute(data: bytes) -> tuple:
        width, height, depth = header(data[:HEADER])
        p = from_png(data)
        x = np.frombuffer(p, np.uint8)
        bands = ",".join(map(str, np.bincount(x >> 5, minlength=8).tolist()))
        feature = f"png:{width}x{height}x{depth};mean={x.mean():.4f};std={x.std():.4f};zeros={int((x == 0).sum())};bands={bands}"
        return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature

    return _with(rows, _adding(store, None, compute, _FEATURES), _FEATURES)


def media_columns(docs: DataFrame, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> (a row for each input row with its payload's place, metadata and features, the manifest).

    Null and empty texts have the payload of 64 zero bytes. Null doc_ids stay, repeated rows come back each, equal texts get
    equal values. Extra columns are ignored; an empty table gives empty ones.
    """
    store = store or scratch_path(docs.sparkSession, "media")
    manifest = store_texts(docs, store)
    found = materialize(read_features(read_headers(by_stripe(manifest), store), store), "media")
    rows = narrow(docs, doc_id="long", text="string")
    rows = rows.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), digest_of("text").alias("digest"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    out = join_by_key(rows, found, "digest", found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    return out.select("doc_id", "n_bytes", *[n for n, _, _ in _FEATURES], F.lower(F.hex("digest")).alias("digest"), "shard", "offset", "length", "width", "height", "depth"), manifest


def tar_members(data: bytes) -> dict[str, bytes]:
    """The members of one shard, as any tar reader sees them."""
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        return {m.name: t.extractfile(m).read() for m in t.getmembers()}
