"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint takes, bit by bit, the majority of the XXH64 hashes of a text's word shingles.
For radius r every bit gets a code of r + 1 random bits, and each non-zero vector v of
that many bits gives a table keyed by the fingerprint bits whose code has an odd product
with v. Two fingerprints that differ in at most r bits leave some v orthogonal to the codes of
all these bits, so they share the key of that table: no pair within the radius is missed.

Fingerprints are looked at once however many documents have them. In a table, keys held by one
fingerprint are dropped before anything is gathered; a key with more than ``BLOCK`` fingerprints is
split into blocks, every pair of which is compared in a task of its own. Tasks emit a spanning
forest of the links they find, never all pairs. Connected components then join them.

A null, empty or blank text has fingerprint zero and is linked like any other. A text with
fewer words than a shingle is one shingle. Repeated rows are documents of their own;
rows without id take the class of their fingerprint. An empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import free_name, slices, text_key
from textloom.llm.components import components
from textloom.runtime import cut

BITS, SEED = 64, 42
#: Fingerprints of one key compared in one task.
BLOCK = 4096
#: Hashes of a text summed up at a time.
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int) -> int:
    """The fingerprint of one text as an unsigned number."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = list(accumulate((len(w) + 1 for w in found)))
    starts = [0, *ends[:-1]]
    last = ends[words - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    total, number = np.zeros(BITS, np.int64), len(last)
    for at in range(0, number, _CHUNK):
        hashes = np.array(
            [digest(joined[s : e - 1], SEED) for s, e in zip(starts[at : at + _CHUNK], last[at : at + _CHUNK])], "<u8"
        )
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > number, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int, name: str, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with the fingerprint as a signed long."""
    kept = [c for c in docs.columns if c != text]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{name}` bigint"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found)], [*kept, name])

    return docs.mapInArrow(work, schema)


def masks(radius: int, seed: int = SEED) -> list[int]:
    """One mask for each non-zero vector; each keeps about half of the bits."""
    rnd = random.Random(seed)
    codes = [rnd.randrange(1 << (radius + 1)) for _ in range(BITS)]
    return [
        sum(1 << i for i, code in enumerate(codes) if bin(code & v).count("1") % 2) for v in range(1, 1 << (radius + 1))
    ]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _roots(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows of a block, or of two blocks, as (row, least row of its component)."""
    both = np.concatenate([a, b]) if b is not a else a
    n = len(both)
    label = np.arange(n)
    linked = []
    for at in range(0, len(a), 512):
        near = np.bitwise_count((a[at : at + 512, None] ^ b[None, :]).view(np.uint64)) <= radius
        x, y = np.nonzero(near)
        linked.append((x + at, y + (len(a) if b is not a else 0)))
    x, y = (np.concatenate([p[k] for p in linked]) for k in (0, 1))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    rows = np.flatnonzero(label != np.arange(n))
    return both[rows], both[label[rows]]


def links(prints: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: links that join what is within ``radius``; ``prints`` holds distinct ``f``."""
    kept = [_signed(m) for m in masks(radius)]
    keyed = prints.select(
        "f", F.posexplode(F.array(*[F.col("f").bitwiseAND(F.lit(m).cast("bigint")) for m in kept])).alias("m", "key")
    )
    shared = keyed.groupBy("m", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut(shared, "shared-keys")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = keyed.join(shared, ["m", "key"]).withColumn("blocks", blocks)
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int"))
    # a block meets itself and every other block of its key once
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "m",
        "key",
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
        (F.col("mine") <= F.col("other")).alias("left"),
        "f",
    )
    group = ["m", "key", "i", "j"]
    dealt = rows.repartition(*group).sortWithinPartitions(*group)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, f, left in _groups(batches, group):
            if keys[2] == keys[3]:
                a, b = _roots(f, f, radius) if len(f) > 1 else (f[:0], f[:0])
            else:
                x, y = f[left], f[~left]
                a, b = _roots(x, y, radius) if len(x) and len(y) else (f[:0], f[:0])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(_gathered(compare), "a bigint, b bigint").distinct()


def _groups(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Runs of equal group columns in sorted batches; a run may go on in the next batch."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    held_key: tuple | None = None
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in group]
        f, left = batch.column("f").to_numpy(), batch.column("left").to_numpy(zero_copy_only=False).astype(bool)
        n = len(f)
        if not n:
            continue
        change = np.zeros(n, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), n]
        for s, e in zip(edges[:-1], edges[1:]):
            key = tuple(int(c[s]) for c in columns)
            if key != held_key:
                if held:
                    yield held_key, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                held, held_key = [], key
            held.append((f[s:e], left[s:e]))
    if held:
        yield held_key, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def _gathered(function, rows: int = 20_000):
    """Join small output batches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for out in function(batches):
            held.append(out)
            n += out.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return work


def _classed(docs: DataFrame, words: int, radius: int, key: str, text: str) -> DataFrame:
    """``(key, t1, t2, f, root, component)``: ``root`` and ``component`` are null for documents alone in their class."""
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *text_key(F.col(text)))
    prints = cut(fingerprints(named, words, "f"), "fingerprints")
    distinct = cut(prints.groupBy("f").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-prints")
    stars = components(links(distinct.select("f"), radius))
    member = distinct.join(stars.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    least = member.groupBy("root").agg(F.min("least").alias("component"), F.sum("n").alias("members"))
    # documents alone in their class need no lookup
    classes = member.join(least, "root").filter("members > 1").select("f", "root", "component")
    return prints.join(classes, "f", "left").select("key", "t1", "t2", "f", "root", "component")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fingerprint, component)``: the class of each row is the smallest key it is linked to."""
    return _classed(docs, words, radius, key, text).select(
        F.col("key").alias(key), hex_digits(F.col("f")).alias("fingerprint"), F.coalesce("component", "key").alias("component")
    )


def hex_digits(f: Column) -> Column:
    return F.lower(F.lpad(F.hex(f), 16, "0"))


def dedup(docs: DataFrame, words: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest key, rows without one last."""
    return first_of_each(docs, cut(_classed(docs, words, radius, key, text), "classes"), key, text)


def first_of_each(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with one row of each class, from ``(key, t1, t2, root)``; ``root`` is null for rows alone in theirs."""
    k, t1, t2, rows, nth = (free_name(docs, n) for n in ("_k", "_t1", "_t2", "_rows", "_nth"))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "t1", "t2")).alias("first")
    alone = found.filter("root IS NULL").select("key", "t1", "t2")
    chosen = found.filter("root IS NOT NULL").groupBy("root").agg(first).select("first.key", "first.t1", "first.t2")
    # rows alone in their class differ in fingerprint, so none of them is another's copy
    stays = alone.unionByName(chosen).toDF(k, t1, t2)
    one, two = text_key(F.col(text))
    same = F.col(key).eqNullSafe(F.col(k)) & (one == F.col(t1)) & (two == F.col(t2))
    kept = docs.join(stays, same, "left_semi")
    if found.groupBy("key", "t1", "t2").agg(F.count(F.lit(1)).alias(rows)).filter(F.col(rows) > 1).limit(1).count():
        # of repeated rows one stays
        by_row = Window.partitionBy(F.col(key), one, two).orderBy(F.lit(1))
        kept = kept.withColumn(nth, F.row_number().over(by_row)).filter(F.col(nth) == 1)
    return kept.select(*docs.columns)
