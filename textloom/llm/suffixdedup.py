"""Removal of repeated byte strings by sorted suffixes.

Every byte that lies in a string of ``span`` bytes which also starts anywhere else goes.
Sorting all suffixes would write each byte ``span`` times, so suffixes are taken at anchors: of the
``span - GRAM + 1`` grams in a window of ``span`` bytes the one with the least hash (the last of
equals) owns the window. Equal windows are owned at the same offset, so each repeated
window is found at an anchor whose gram also stands elsewhere, and only there.

1. Grams of anchors are counted; anchors with a gram seen once own no repeated window.
2. An anchor's context is all bytes of the windows it owns. Contexts that are equal to another one
   are repeated whole; that takes their hashes only.
3. Single contexts, and one of each repeated context that shares a gram with a single one, go to
   buckets: ranges of their gram's leading bytes, with splitters sampled by Spark. A bucket sorts its
   windows by gram, offset from the anchor and content, and compares neighbours, also across
   the batches it comes in. A gram with more than ``MOST`` contexts is not sorted in one bucket; its
   windows are counted over all tasks.
4. The repeated windows of a text are joined into runs and cut out.

Contents are compared by 64-bit polynomial hashes within equal gram and offset, contexts and
texts by 128-bit hashes. Equal texts are worked on once, with their number of copies. A null text is an
empty text; texts shorter than ``span`` stay whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import free_name, slices, text_key
from textloom.runtime import cut, shuffle_width

#: Bytes of a gram; contexts of one gram that a task sorts; windows hashed at a time.
GRAM, MOST, _CHUNK = 100, 2000, 1 << 18
#: Rows of contexts whose windows a task holds at a time; a gram's contexts stay together.
_ROWS = 1000
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES: dict[str, np.ndarray] = {}
_LOW = np.uint64(0xFFFFFFFF)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and powers of the base and of its inverse modulo 2**64."""
    if "byte" not in _TABLES:
        _TABLES["byte"] = np.random.default_rng(2024).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    if len(_TABLES.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            powers = np.full(n, base, np.uint64)
            powers[0] = 1
            _TABLES[name] = np.multiply.accumulate(powers)
    return _TABLES["byte"], _TABLES["up"][:n], _TABLES["down"][:n]


def _sums(data: np.ndarray) -> np.ndarray:
    byte, up, _ = _tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte[data] * up[: len(data)], out=out[1:])
    return out


def _hashes(sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings of ``length`` bytes at ``starts``, wherever they stand."""
    down = _tables(len(sums))[2]
    return (sums[starts + length] - sums[starts]) * down[starts]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, first, last, gram)``: anchors, the first and last window they own, and their gram's hash."""
    found = []
    for at in range(0, len(data) - span + 1, _CHUNK):
        part = data[at : at + _CHUNK + span - 1]
        sums = _sums(part)
        gram = _hashes(sums, np.arange(len(part) - GRAM + 1), GRAM)
        gram = (gram ^ (gram >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        packed = (gram & ~_LOW) | (_LOW - np.arange(len(gram), dtype=np.uint64))
        owner = (_LOW - (_least(packed, span - GRAM + 1) & _LOW)).astype(np.int64)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        last = np.append(first[1:], len(owner)) - 1
        x = owner[first]
        found.append((x + at, first + at, last + at, gram[x].view(np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate([f[k] for f in found]) for k in range(4))


def _bytes(text) -> bytes:
    return b"" if text is None else text if isinstance(text, bytes) else text.encode("utf-8")


def _grams(docs: DataFrame, span: int, text: str) -> DataFrame:
    """``(t1, t2, g)`` of every anchor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", 4 << 20):
            found = [anchors(np.frombuffer(_bytes(t.as_py()), np.uint8), span)[3] for t in batch.column("body")]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            grams = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("t1").take(row), batch.column("t2").take(row), pa.array(grams)], ["t1", "t2", "g"]
            )

    long_enough = docs.filter(F.octet_length(text) >= span).select(*text_key(F.col(text)), F.col(text).alias("body"))
    return long_enough.mapInArrow(work, "t1 bigint, t2 bigint, g bigint")


_PLACE = "t1 bigint, t2 bigint, copies bigint, lead bigint, g bigint, c1 bigint, c2 bigint, a bigint, x bigint, b bigint"


def _places(texts: DataFrame, span: int) -> DataFrame:
    """Every anchor with a repeated gram: its gram, its context's hash and the windows it owns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", 4 << 20):
            rows, numbers = [], []
            for k in range(batch.num_rows):
                data = _bytes(batch.column("body")[k].as_py())
                x, a, b, g = anchors(np.frombuffer(data, np.uint8), span)
                mine = np.isin(g, np.asarray(batch.column("gs")[k].values))
                for xx, aa, bb, gg in zip(x[mine].tolist(), a[mine].tolist(), b[mine].tolist(), g[mine].tolist()):
                    digest = xxhash.xxh3_128_digest((xx - aa).to_bytes(4, "little") + data[aa : bb + span])
                    numbers.append(
                        (
                            int.from_bytes(data[xx : xx + 8], "big") >> 1,
                            gg,
                            int.from_bytes(digest[:8], "little", signed=True),
                            int.from_bytes(digest[8:], "little", signed=True),
                            aa,
                            xx,
                            bb,
                        )
                    )
                    rows.append(k)
            row = pa.array(rows, pa.int64())
            columns = np.array(numbers, np.int64).reshape(-1, 7).T
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(row) for c in ("t1", "t2", "copies")), *map(pa.array, columns)],
                ["t1", "t2", "copies", "lead", "g", "c1", "c2", "a", "x", "b"],
            )

    return texts.mapInArrow(work, _PLACE)


_CONTEXT = "lead bigint, g bigint, c1 bigint, c2 bigint, n bigint, off int, context binary"


def _contexts(wanted: DataFrame, texts: DataFrame, span: int) -> DataFrame:
    """The bytes of the wanted contexts, each from one text that has it."""
    listed = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("lead", "g", "c1", "c2", "n", "a", "x", "b")).alias("wanted"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", 4 << 20):
            rows, bodies = [], []
            for body, some in zip(batch.column("body"), batch.column("wanted").to_pylist()):
                data = _bytes(body.as_py())
                rows += [(w["lead"], w["g"], w["c1"], w["c2"], w["n"], w["x"] - w["a"]) for w in some]
                bodies += [data[w["a"] : w["b"] + span] for w in some]
            columns = np.array(rows, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns[:5]), pa.array(columns[5].astype(np.int32)), pa.array(bodies, pa.binary())],
                ["lead", "g", "c1", "c2", "n", "off", "context"],
            )

    return texts.select("t1", "t2", "body").join(listed, ["t1", "t2"]).drop("t1", "t2").mapInArrow(work, _CONTEXT)


def _windows(batch: pa.RecordBatch | pa.Table, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of the contexts: row, place in the context, offset from the anchor, hash."""
    bodies = batch.column("context").to_pylist()
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    count = np.maximum(size - span + 1, 0)
    row = np.repeat(np.arange(len(bodies)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(np.cumsum(size) - size, count) + place
    sums = _sums(np.frombuffer(b"".join(bodies), np.uint8))
    offset = batch.column("off").to_numpy()[row] - place
    return row, place, offset, _hashes(sums, begin, span)


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches regrouped so that no gram stands in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        g = batch.column("g").to_numpy()
        change = np.flatnonzero(g[1:] != g[:-1])
        if len(change):
            at = int(change[-1]) + 1
            held[-1] = batch.slice(0, at)
            yield pa.Table.from_batches(held).combine_chunks()
            held = [batch.slice(at)]
        elif len(held) > 1 and held[-2].column("g")[held[-2].num_rows - 1].as_py() != int(g[0]):
            yield pa.Table.from_batches(held[:-1]).combine_chunks()
            held = held[-1:]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_FOUND = "g bigint, c1 bigint, c2 bigint, lo int, hi int"


def _sorted_compare(contexts: DataFrame, span: int) -> DataFrame:
    """Repeated windows of single contexts, as ranges of places, by sorting buckets of suffixes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(part.slice(at, _ROWS) for part in batches for at in range(0, part.num_rows, _ROWS)):
            row, place, offset, content = _windows(table, span)
            g = table.column("g").to_numpy()
            run = np.cumsum(np.diff(g, prepend=g[:1]) != 0)[row]
            order = np.lexsort((content, offset, run))
            same = (np.diff(run[order]) == 0) & (np.diff(offset[order]) == 0) & (np.diff(content[order]) == 0)
            repeated = np.zeros(len(row), bool)
            repeated[order[1:][same]] = True
            repeated[order[:-1][same]] = True
            repeated &= (table.column("n").to_numpy() == 1)[row]
            at = np.flatnonzero(repeated)
            if not len(at):
                continue
            begins = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(row[at], prepend=-1) != 0))
            ends = np.append(begins[1:], len(at)) - 1
            where = row[at[begins]]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(table.column(c).to_numpy()[where]) for c in ("g", "c1", "c2")),
                    pa.array(place[at[begins]].astype(np.int32)),
                    pa.array(place[at[ends]].astype(np.int32)),
                ],
                ["g", "c1", "c2", "lo", "hi"],
            )

    width = shuffle_width(contexts.sparkSession)
    dealt = contexts.repartitionByRange(width, "lead", "g").sortWithinPartitions("lead", "g")
    return dealt.mapInArrow(work, _FOUND)


def _counted_compare(contexts: DataFrame, span: int) -> DataFrame:
    """The same for grams with many contexts: windows are counted over all tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                row, place, offset, content = _windows(batch, span)
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(taken) for c in ("g", "c1", "c2", "n")),
                        pa.array(place.astype(np.int32)),
                        pa.array(offset.astype(np.int32)),
                        pa.array(content.view(np.int64)),
                    ],
                    ["g", "c1", "c2", "n", "lo", "offset", "content"],
                )

    schema = "g bigint, c1 bigint, c2 bigint, n bigint, lo int, offset int, content bigint"
    windows = contexts.mapInArrow(work, schema)
    often = windows.groupBy("g", "offset", "content").count().filter("count > 1").drop("count")
    single = windows.filter("n = 1").join(often, ["g", "offset", "content"], "left_semi")
    return single.select("g", "c1", "c2", "lo", F.col("lo").alias("hi"))


def cut_texts(docs: DataFrame, span: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(t1, t2, kept, n_removed, n_spans)`` of every text that loses bytes; ``kept`` is binary."""
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("body"), *text_key(F.col(text)))
    found = cut(_grams(docs, span, text), "grams")
    # written, so that joins with it see two plain exchanges and Spark can split a common gram
    often = cut(found.groupBy("g").count().filter("count > 1").select("g"), "common-grams")
    listed = found.join(often, "g", "left_semi").groupBy("t1", "t2").agg(F.collect_set("g").alias("gs"))
    # of equal texts the row with the least key stands for all
    per_key = named.groupBy("t1", "t2", "key").agg(F.count(F.lit(1)).alias("rows"))
    one = per_key.groupBy("t1", "t2").agg(
        F.min("key").alias("least"), F.sum("rows").alias("copies"), F.max("rows").alias("rows")
    )
    listed = cut(listed.join(one, ["t1", "t2"]), "texts-with-grams")
    texts = named.withColumnRenamed("key", "least")
    same = (texts.t1 == listed.t1) & (texts.t2 == listed.t2) & texts.least.eqNullSafe(listed.least)
    texts = texts.join(listed, same).select(listed.t1, listed.t2, "copies", "gs", "body")
    if listed.filter("rows > 1").limit(1).count():
        texts = texts.dropDuplicates(["t1", "t2"])
    texts = cut(texts, "texts")

    places = cut(_places(texts, span), "places")
    context = ["lead", "g", "c1", "c2"]
    kinds = places.groupBy(*context).agg(
        F.sum("copies").alias("n"), F.min(F.struct("t1", "t2", "a", "x", "b")).alias("at")
    )
    kinds = cut(kinds.select(*context, "n", "at.*"), "contexts")
    grams = kinds.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("n") == 1, 1)).alias("single"))
    grams = cut(grams.filter("m > 1 AND single > 0").select("g", "m"), "compared-grams")
    wanted = kinds.join(grams, "g")
    few = _sorted_compare(_contexts(wanted.filter(F.col("m") <= MOST), texts, span), span)
    many = _counted_compare(_contexts(wanted.filter(F.col("m") > MOST), texts, span), span)
    whole = kinds.filter("n > 1").select("g", "c1", "c2", F.lit(0).alias("lo"), F.lit(None).cast("int").alias("hi"))
    repeated = cut(whole.unionByName(few).unionByName(many), "repeated")
    spans = places.join(repeated, ["g", "c1", "c2"]).select(
        "t1", "t2", (F.col("a") + F.col("lo")).alias("lo"), F.coalesce(F.col("a") + F.col("hi"), "b").alias("hi")
    )
    spans = spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return texts.select("t1", "t2", "body").join(spans, ["t1", "t2"]).mapInArrow(
        _cutter(span), "t1 bigint, t2 bigint, kept binary, n_removed bigint, n_spans bigint"
    )


def _cutter(span: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            kept, removed, runs = [], [], []
            for body, spans in zip(batch.column("body"), batch.column("spans")):
                data = _bytes(body.as_py())
                change = np.zeros(len(data) + 1, np.int64)
                np.add.at(change, spans.values.field("lo").to_numpy(), 1)
                np.add.at(change, spans.values.field("hi").to_numpy() + span, -1)
                gone = np.cumsum(change[:-1]) > 0
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
                removed.append(int(gone.sum()))
                runs.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("t1"),
                    batch.column("t2"),
                    pa.array(kept, pa.binary()),
                    pa.array(removed, pa.int64()),
                    pa.array(runs, pa.int64()),
                ],
                ["t1", "t2", "kept", "n_removed", "n_spans"],
            )

    return work


def dedup(docs: DataFrame, span: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` plus ``kept`` (binary: what stays of the text), ``n_removed`` and ``n_spans``.

    These names get underscores in front where ``docs`` has columns of the same names.
    """
    found = cut(cut_texts(docs, span, key, text), "cut-texts")
    added = {n: free_name(docs, n) for n in ("kept", "n_removed", "n_spans")}
    hidden = {n: free_name(docs, f"_{n}") for n in ("t1", "t2", *added)}
    found = found.withColumnsRenamed(hidden)
    one, two = text_key(F.col(text))
    joined = docs.join(found, (one == F.col(hidden["t1"])) & (two == F.col(hidden["t2"])), "left")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return joined.select(
        *docs.columns,
        F.coalesce(F.col(hidden["kept"]), body).alias(added["kept"]),
        F.coalesce(F.col(hidden["n_removed"]), F.lit(0)).alias(added["n_removed"]),
        F.coalesce(F.col(hidden["n_spans"]), F.lit(0)).alias(added["n_spans"]),
    )
