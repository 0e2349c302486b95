"""Near copies by the Jaccard similarity of word shingles, each link verified exactly.

A text is the set of its shingles of ``words`` words, blank-separated and with A-Z in lower case; one with
fewer words is one shingle. Candidates share a band: ``ROWS`` of ``BANDS * ROWS`` min-hashes. A pair of
similarity s shares one with probability 1 - (1 - s ** ROWS) ** BANDS: 99.96 % at 0.8, 99.9999994 % at 0.9.

No pair is linked, and no two are brought together, for a chain of shared bands. First each text of a band key is compared
with the least one of the key, which joins the copies of a text in about as many comparisons as there are copies. Then the
keys whose texts are not all in one class of verified links are looked at again, and their texts of different classes
compared. Keys of more than ``BLOCK`` bytes or ``MEMBERS`` texts are split into blocks, every pair of which is a task of its
own; comparisons with one text are split by ``MEMBERS``, too. Connected components are those of verified links only.

With ``radius`` the links of :mod:`textloom.llm.simhash` come first: fingerprints of shingles of ``print_words`` words that differ
in so many bits or fewer link their texts. The verified links then join what such a radius misses.

Texts of equal words are looked at once, so repeated rows and copies cost nothing. Null, empty and blank texts are copies
of each other; rows without key are rows like others. An empty table gives an empty result; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import slices, text_key
from textloom.llm.components import components
from textloom.llm.simhash import first_of_each, fingerprint
from textloom.llm.simhash import links as print_links
from textloom.runtime import cut, shuffle_width

BANDS, ROWS = 20, 5
#: Bytes of text, and texts, of one key that are compared in one task.
BLOCK, MEMBERS = 16 << 20, 512
#: Shingles hashed at a time.
_CHUNK = 1 << 14

_draw = np.random.default_rng(42)
_MIX = _draw.integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
_TIMES, _FLIP = _MIX[0] * np.uint64(2) + np.uint64(1), _MIX[1]


def shingles(text: str | None, words: int) -> tuple[int, np.ndarray]:
    """A hash of all words, and the sorted distinct hashes of the shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        hashes = [digest(joined)]
    else:
        ends = np.cumsum([len(w) + 1 for w in found]).tolist()
        hashes = [digest(joined[s : e - 1]) for s, e in zip([0, *ends], ends[words - 1 :])]
    return digest(joined, 7), np.unique(np.array(hashes, np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of the min-hashes of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        mixed = hashes[None, at : at + _CHUNK] ^ _FLIP[:, None]
        mixed *= _TIMES[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in rows], np.uint64).view(np.int64)


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets are at least ``least`` similar; a tolerance far below 1 / (number of shingles) for rounding."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = int((b[at] == a).sum())
    return shared + 1e-9 >= least * (len(a) + len(b) - shared)


def linked(sets: list[np.ndarray], classes: list[int], left: list[bool] | None, least: float) -> list[tuple[int, int]]:
    """A spanning forest, over what ``classes`` join already, of the pairs that are similar.

    With ``left``, only pairs of one row of it and one other row are compared.
    """
    label, out = np.unique(np.array(classes), return_inverse=True)[1], []
    for x in range(len(sets)):
        for y in range(x):
            if label[y] != label[x] and (left is None or left[x] != left[y]) and similar(sets[x], sets[y], least):
                out.append((x, y))
                label[label == label[y]] = label[x]
    return out


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _links_to_least(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Those of ``a, b`` whose texts are similar. Rows of one ``b`` are dealt to as many tasks as they need."""
    shares = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("shares"))
    asked = pairs.join(shares, "b").select("b", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"), F.col("a").alias("f"))
    heads = shares.select("b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("b").alias("f"))
    rows = asked.unionByName(heads).join(texts, "f").withColumn("head", F.col("f") == F.col("b"))
    dealt = rows.repartition(shuffle_width(pairs.sparkSession), "b", "share").sortWithinPartitions("b", "share", F.desc("head"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in slices(batches, "text"):
            found = []
            for b, f, text in zip(batch.column("b").to_pylist(), batch.column("f").to_pylist(), batch.column("text")):
                shingled = shingles(text.as_py(), words)[1]
                if f == b:
                    head = shingled
                elif similar(head, shingled, least):
                    found.append((f, b))
            if found:
                yield _pairs(found)

    return dealt.mapInArrow(compare, "a bigint, b bigint")


def _links_in_keys(members: DataFrame, words: int, least: float) -> DataFrame:
    """``(a, b)`` from ``(m, band, i, j, left, f, class, text)``, one task for each ``(m, band, i, j)``."""
    group = ["m", "band", "i", "j"]
    dealt = members.repartition(shuffle_width(members.sparkSession), *group).sortWithinPartitions(*group)

    def flush(key: tuple, held: list[tuple[int, int, bool, np.ndarray]]) -> pa.RecordBatch | None:
        names, classes, sides, sets = (list(x) for x in zip(*held))
        found = linked(sets, classes, None if key[2] == key[3] else sides, least)
        return _pairs([(names[x], names[y]) for x, y in found]) if found else None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in slices(batches, "text"):
            columns = [batch.column(c).to_pylist() for c in (*group, "f", "class", "left")]
            for *key, f, name, side, text in zip(*columns, batch.column("text")):
                if key != now:
                    if held and (out := flush(now, held)):
                        yield out
                    now, held = key, []
                held.append((f, name, side, shingles(text.as_py(), words)[1]))
        if held and (out := flush(now, held)):
            yield out

    return dealt.mapInArrow(compare, "a bigint, b bigint")


def _links_of_prints(distinct: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: links between ``f, print`` whose fingerprints differ in ``radius`` bits or fewer."""
    heads = cut(distinct.groupBy("print").agg(F.min("f").alias("head")), "print-heads")
    equal = distinct.join(heads, "print").filter("f <> head").select(F.col("f").alias("a"), F.col("head").alias("b"))
    near = print_links(heads.select(F.col("print").alias("f")), radius)
    for side in ("a", "b"):
        near = near.join(heads.withColumnRenamed("print", side), side).drop(side).withColumnRenamed("head", f"{side}_head")
    return equal.unionByName(near.select(F.col("a_head").alias("a"), F.col("b_head").alias("b")))


def classed(
    docs: DataFrame,
    words: int = 5,
    least: float = 0.8,
    key: str = "doc_id",
    text: str = "text",
    radius: int | None = None,
    print_words: int = 4,
) -> DataFrame:
    """``(key, t1, t2, f, root)``: ``root`` is null for documents alone in their class, ``f`` a hash of the words."""
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *text_key(F.col(text)))
    schema = f"key {named.schema['key'].dataType.simpleString()}, t1 bigint, t2 bigint, f bigint, print bigint, keys array<bigint>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t.as_py() for t in batch.column("text")]
            found = [shingles(t, words) for t in texts]
            keys = pa.array([bands(s) for _, s in found], pa.list_(pa.int64()))
            f = pa.array([_signed(n) for n, _ in found], pa.int64())
            printed = pa.array([None if radius is None else _signed(fingerprint(t, print_words)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "t1", "t2")), f, printed, keys], ["key", "t1", "t2", "f", "print", "keys"]
            )

    prints = cut(named.mapInArrow(work, schema), "band-keys")
    # one row of each word list stands for the others; its words give its fingerprint, too
    row = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "t1", "t2")).alias("row")
    lists = prints.groupBy("f").agg(F.first("keys").alias("keys"), F.first("print").alias("print"), row, F.count(F.lit(1)).alias("n"))
    distinct = cut(lists, "word-lists")
    keyed = cut(distinct.select("f", F.posexplode("keys").alias("m", "band")), "bands")
    shared = keyed.groupBy("m", "band").agg(F.min("f").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut(shared.drop("n"), "shared-bands")
    held = cut(keyed.join(shared, ["m", "band"]).select("m", "band", "f", "least"), "held-keys")

    # the texts that share a band with another, each once
    candidates = distinct.join(held.select("f").distinct(), "f").select("f", "row.*")
    candidates = cut(candidates.select(*(F.col(c).alias(f"c_{c}") for c in ("f", "key", "t1", "t2"))), "candidates")
    same = F.col("key").eqNullSafe(F.col("c_key")) & (F.col("t1") == F.col("c_t1")) & (F.col("t2") == F.col("c_t2"))
    # repeated rows of one key and text give the same text
    texts = named.join(candidates, same).groupBy(F.col("c_f").alias("f")).agg(F.first("text").alias("text"))
    texts = cut(texts, "candidate-texts")

    pairs = cut(held.filter("f <> least").select(F.col("f").alias("a"), F.col("least").alias("b")).distinct(), "least-pairs")
    links = _links_to_least(pairs, texts, words, least)
    if radius is not None:
        links = links.unionByName(_links_of_prints(distinct.select("f", "print"), radius))
    links = cut(links, "links")
    near = components(links).withColumnRenamed("node", "f")

    # a key of two texts has no other pair
    classed_keys = cut(held.join(near, "f", "left").select("m", "band", "f", F.coalesce("root", "f").alias("class")), "classed-keys")
    open_keys = classed_keys.groupBy("m", "band").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi"))
    open_keys = open_keys.filter((F.col("n") > 2) & (F.col("lo") != F.col("hi"))).select("m", "band")
    sized = texts.select("f", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    members = cut(classed_keys.join(open_keys, ["m", "band"]).join(sized, "f"), "open-keys")
    parts = members.groupBy("m", "band").agg(
        F.ceil(F.greatest(F.sum(F.col("bytes") + 64) / BLOCK, F.count(F.lit(1)) / MEMBERS)).cast("int").alias("blocks")
    )
    members = members.join(parts, ["m", "band"]).withColumn("mine", F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int"))
    # a block meets itself and every other block of its key once
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "m",
        "band",
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
        (F.col("mine") <= F.col("other")).alias("left"),
        "f",
        "class",
    )
    more = cut(_links_in_keys(members.join(texts, "f"), words, least), "more-links")
    stars = components(links.unionByName(more))
    member = distinct.select("f", "n").join(stars.withColumnRenamed("node", "f"), "f", "left")
    member = member.withColumn("root", F.coalesce("root", "f")).filter("n > 1 OR root IS NOT NULL")
    sizes = member.groupBy("root").agg(F.sum("n").alias("members")).filter("members > 1").select("root")
    return prints.drop("keys").join(member.join(sizes, "root").select("f", "root"), "f", "left").select("key", "t1", "t2", "f", "root")


def dedup(
    docs: DataFrame,
    words: int = 5,
    least: float = 0.8,
    key: str = "doc_id",
    text: str = "text",
    radius: int | None = None,
    print_words: int = 4,
) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest key, rows without one last."""
    return first_of_each(docs, cut(classed(docs, words, least, key, text, radius, print_words), "classes"), key, text)
