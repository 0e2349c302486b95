"""Token ids in directly addressable codes: any token is read without decoding a block.

An id is cut into chunks of ``WIDTH`` bits, lowest first. Level 0 holds the first chunk of
every id, level 1 the second chunk of those ids that have one, and so on. Each level has a
bitmap that says which of its chunks go on, and a rank directory: the ones before each
``STRIDE`` bits. The chunk of id *i* on the next level stands at the rank of bit *i*, so one
id costs one step a level.

A shard file, all numbers little-endian::

    b"TLDC", u32 number of levels, u64 number of ids, then for each level
    u64 number of chunks, chunks (u8 each), bitmap (bit k of byte j: chunk 8 j + k goes on;
    filled up to whole bytes), u32 rank of every STRIDE chunks

Shards are rows of a Parquet table (``shard``, ``doc_ids``, ``edges``, ``payload``), so that
Spark commits, reads and finds them on any store. Rows of documents are in ascending
order of id within and across shards, null first; a null text is an empty document;
repeated rows are documents of their own; an empty table gives no shard.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import slices
from textloom.llm.tokens import encoder, ended
from textloom.runtime import cut, running, shuffle_width

WIDTH, STRIDE = 8, 512
_BYTE_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(ids: np.ndarray) -> bytes:
    """The shard file of a list of ids below 2**32."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        chunks, rest = (rest & 0xFF).astype(np.uint8), rest >> WIDTH
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), STRIDE)) if len(more) else np.zeros(0, np.int64)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        levels.append(struct.pack("<Q", len(chunks)) + chunks.tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more]
        if not len(rest):
            break
    return b"TLDC" + struct.pack("<IQ", len(levels), len(ids)) + b"".join(levels)


class Shard:
    """A shard file opened for reading."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != b"TLDC":
            raise ValueError("not a shard of token codes")
        count, self.length = struct.unpack_from("<IQ", payload, 4)
        at, self.levels = 16, []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", payload, at)
            at += 8
            chunks = np.frombuffer(payload, np.uint8, n, at)
            bits = np.frombuffer(payload, np.uint8, -(-n // 8), at + n)
            ranks = np.frombuffer(payload, "<u4", -(-n // STRIDE), at + n + len(bits))
            at += n + len(bits) + 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.length:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not (bits[i >> 3] >> (i & 7)) & 1:
                return value
            block = i // STRIDE
            before = bits[block * STRIDE // 8 : i >> 3]
            rank = int(ranks[block]) + int(_BYTE_ONES[before].sum())
            i = rank + int(_BYTE_ONES[int(bits[i >> 3]) & ((1 << (i & 7)) - 1)])
            shift += WIDTH
        raise ValueError("a chunk goes on beyond the last level")

    def all(self) -> np.ndarray:
        """Every id in order."""
        value = None
        for chunks, bits, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            if value is not None:
                here[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)] |= value << WIDTH
            value = here
        return value


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", shards: int | None = None) -> None:
    """Encode all texts and write their shards: documents are range partitioned by id, each slice of a partition is a shard."""
    kind = docs.schema[key].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer).encode
        for number, batch in enumerate(slices(batches, text)):
            flat, edges = ended(*ids(batch.column(text)), end_id)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_part").slice(0, 1),
                    pa.array([number], pa.int32()),
                    pa.array([batch.column(key).to_pylist()], pa.list_(batch.schema.field(key).type)),
                    pa.array([edges.tolist()], pa.list_(pa.int64())),
                    pa.array([encode(flat)], pa.binary()),
                ],
                ["part", "number", "doc_ids", "edges", "payload"],
            )

    ordered = (
        docs.select(key, text)
        .repartitionByRange(shards or shuffle_width(docs.sparkSession), F.col(key).asc_nulls_first())
        .sortWithinPartitions(F.col(key).asc_nulls_first(), F.xxhash64(text))
        .withColumn("_part", F.spark_partition_id())
    )
    schema = f"part int, number int, doc_ids array<{kind}>, edges array<bigint>, payload binary"
    coded = ordered.mapInArrow(build, schema)
    coded.select(
        (F.col("part").cast("bigint") * (1 << 32) + F.col("number")).alias("shard"), "doc_ids", "edges", "payload"
    ).write.parquet(path)


def read(spark: SparkSession, path: str, key: str = "doc_id", wanted: Column | str = "ids") -> DataFrame:
    """Per document: ``key``, ``start`` (ids of all documents before it), ``n_tokens`` and ``wanted``.

    ``wanted`` is made of ``ids`` (binary, unsigned 32-bit little-endian) where they are decoded, before rows meet
    the table of shards.
    """
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    # one number a shard is summed up, over ranges of shards
    sizes = files.select("shard", F.element_at("edges", -1).alias("_n"))
    begins = cut(running(sizes, [], ["shard"], {"_before": ("sum", F.col("_n"))}).select("shard", "_before"), "begins")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                edges = np.asarray(batch.column("edges")[row].values)
                raw = Shard(batch.column("payload")[row].as_py()).all().astype("<u4").tobytes()
                ids = [raw[4 * a : 4 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[row].values,
                        pa.array(np.repeat(batch.column("shard")[row].as_py(), len(ids))),
                        pa.array(edges[:-1]),
                        pa.array(np.diff(edges)),
                        pa.array(ids, pa.binary()),
                    ],
                    [key, "_shard", "_at", "n_tokens", "ids"],
                )

    docs = files.mapInArrow(unfold, f"`{key}` {kind}, _shard bigint, _at bigint, n_tokens bigint, ids binary")
    docs = docs.select(key, "_shard", "_at", "n_tokens", wanted)
    begins = begins.withColumnRenamed("shard", "_shard")
    return docs.join(begins, "_shard", "left").select(
        key, (F.col("_at") + F.coalesce("_before", F.lit(0))).alias("start"), *docs.columns[3:]
    )
