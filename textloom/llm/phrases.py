"""Phrase collocations of each group of texts, by counts of neighbouring ids in tiles.

Words are ranked by frequency, so that frequent ones have small numbers. A pair of neighbouring
numbers falls in the tile ``(left // SIDE, right // SIDE)``: a tile with many pairs is counted into a
dense square by ``bincount``, the pairs of all others as sorted coordinates. Frequent pairs are
ranked like words, and the streams of their ids are counted in the same way: neighbouring
pairs overlap by a word and make phrases of three words, and so on. A phrase is never more frequent
than its parts, so rare words and pairs can be left out on the way and no count changes.

Texts are cut into *blocks* of one group, some MB of text. A block numbers its distinct words
itself; a join of those rows, not of tokens, with the ranked words gives them their ids, whatever
the number of words. Counts of a block are added up by Spark, and no key has more than one row a block.

A null text is empty; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import give_back, slices
from textloom.runtime import cut, cut_to, position, remove_path

#: Ids a side of a tile; pairs from which a tile is counted as a dense square.
SIDE, DENSE = 1024, 1 << 17
BLOCK_BYTES = 6 << 20
#: Neighbours of a stream that are looked up at a time.
STRETCH = 1 << 16

# The ends of pieces, and the white space between words (a tab and a blank).
ENDS = r"[.,;:!?\n-\r]+"
END = "."


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as bytes, all lowest bytes first: small numbers then compress well."""
    values = np.ascontiguousarray(values, "<i4")
    return values.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def tile_counts(left: np.ndarray, right: np.ndarray, side: int = SIDE, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs as ``left << 32 | right`` in order, and how often each occurs."""
    left, right = left.astype(np.int64), right.astype(np.int64)
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tile = (left // side) << 32 | (right // side)
    order = np.argsort(tile, kind="stable")
    left, right, tile = left[order], right[order], tile[order]
    edges = np.flatnonzero(np.diff(tile, prepend=tile[0] - 1, append=tile[-1] + 1))
    sparse, keys, counts = np.ones(len(tile), bool), [], []
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a >= dense:
            sparse[a:b] = False
            square = np.bincount(left[a:b] % side * side + right[a:b] % side, minlength=side * side)
            cells = np.flatnonzero(square)
            row, column = tile[a] >> 32, tile[a] & 0xFFFFFFFF
            keys.append((row * side + cells // side) << 32 | (column * side + cells % side))
            counts.append(square[cells])
    coordinates = np.sort(left[sparse] << 32 | right[sparse])
    first = np.flatnonzero(np.diff(coordinates, prepend=-1))
    keys, counts = np.concatenate([*keys, coordinates[first]]), np.concatenate([*counts, np.diff(first, append=len(coordinates))])
    order = np.argsort(keys)
    return keys[order], counts[order]


def _block(block: int, grp: str | None, texts: pa.Array) -> pa.RecordBatch:
    """Texts of one group as numbers of its words, -1 where a piece ends; frequent words have small numbers."""
    texts = pc.replace_substring_regex(pc.ascii_lower(texts.cast(pa.large_string())), ENDS, f" {END} ")
    # two blanks in a row, and one at either end, leave an empty word
    coded = pc.split_pattern(pc.replace_substring(texts, "\t", " "), " ").flatten().dictionary_encode()
    codes, words = np.asarray(coded.indices), coded.dictionary
    codes = codes[codes != pc.index(words, pa.scalar("", words.type)).as_py()]
    is_end = np.asarray(pc.is_in(words, pa.array([END, ""], words.type)).to_numpy(zero_copy_only=False), bool)
    counts = np.bincount(codes, minlength=len(words))
    counts[is_end] = 0
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    place[is_end] = -1
    order = order[: len(order) - int(is_end.sum())]
    built = pa.RecordBatch.from_pydict(
        {
            "block": pa.array([block], pa.int64()),
            "grp": pa.array([grp], pa.string()),
            "words": pa.array([words.take(pa.array(order)).cast(pa.string())], pa.list_(pa.string())),
            "counts": pa.array([counts[order]], pa.list_(pa.int64())),
            "codes": pa.array([packed(place[codes])], pa.binary()),
        }
    )
    del texts, coded, words, codes, order, place
    give_back()
    return built


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts gathered by group until a group, or all groups together, are large enough."""
    block = TaskContext.get().partitionId() << 40
    waiting: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}
    for part in slices(batches, "text", BLOCK_BYTES // 2):
        names = pa.array(part.column("grp"))
        for name in names.unique():
            texts = part.column("text").filter(pc.equal(names, name))
            waiting.setdefault(name.as_py(), []).append(texts)
            size[name.as_py()] = size.get(name.as_py(), 0) + texts.nbytes
        full = [g for g, n in size.items() if n >= BLOCK_BYTES]
        if sum(size.values()) >= 2 * BLOCK_BYTES:
            full = list(size)
        for grp in full:
            block += 1
            del size[grp]
            yield _block(block, grp, pa.concat_arrays(waiting.pop(grp)))
    for grp, texts in waiting.items():
        block += 1
        yield _block(block, grp, pa.concat_arrays(texts))


_STREAM = "block long, grp string, stream binary, ids array<long>"
_PAIRS = "block long, grp string, left long, right long, n long"


def _stream(block: pa.Scalar, grp: pa.Scalar, stream: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """A block as numbers of its own, -1 for what is rare, and the id of each number."""
    columns = {"block": pa.array([block]), "grp": pa.array([grp]), "stream": pa.array([packed(stream)], pa.binary())}
    return pa.RecordBatch.from_pydict(columns | {"ids": pa.array([ids], pa.list_(pa.int64()))})


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, grp, left, right, n``: distinct neighbours of each block's stream, by their ids."""
    for batch in batches:
        for block, grp, stream, ids in zip(*(batch.column(c) for c in ("block", "grp", "stream", "ids"))):
            stream, ids = unpacked(stream.as_py()), np.asarray(ids.values)
            both = (stream[:-1] >= 0) & (stream[1:] >= 0)
            keys, counts = tile_counts(stream[:-1][both], stream[1:][both])
            for at in range(0, len(keys), 1 << 16):
                part, n = keys[at : at + (1 << 16)], counts[at : at + (1 << 16)]
                columns = [pa.array(np.full(len(part), block.as_py())), pa.array([grp.as_py()]).take(pa.array(np.zeros(len(part), np.int8)))]
                columns += [pa.array(ids[part >> 32]), pa.array(ids[part & 0xFFFFFFFF]), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "grp", "left", "right", "n"])
            del stream, ids, both, keys, counts
            give_back()


def _recode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, grp, codes, found in zip(*(batch.column(c) for c in ("block", "grp", "codes", "found"))):
            at, known = (np.asarray(found.values.field(c)) for c in ("left", "id"))
            codes = unpacked(codes.as_py())
            # words are numbered by frequency in the block already; the last number is that of the end of a piece, -1
            ids = np.full(max(int(codes.max(initial=-1)), int(at.max(initial=-1))) + 2, -1, np.int64)
            ids[at] = known
            yield _stream(block, grp, np.where(ids[codes] >= 0, codes, -1), ids)
            give_back()


def _recode_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, grp, stream, ids, found in zip(*(batch.column(c) for c in ("block", "grp", "stream", "ids", "found"))):
            left, right, total = (np.asarray(found.values.field(c)) for c in ("left", "right", "total"))
            known = np.asarray(found.values.field("id")) if "id" in {f.name for f in found.values.type} else left << 32 | right
            ids, stream = np.asarray(ids.values), unpacked(stream.as_py()).astype(np.int64)
            # from ids back to the numbers of this block
            order = np.argsort(ids)
            back = [order[np.searchsorted(ids[order], side)].astype(np.int64) for side in (left, right)]
            # frequent pairs are ranked again: the most frequent of all texts has the smallest number
            rank = np.argsort(-total, kind="stable")
            keys = (back[0] << 32 | back[1])[rank]
            by_key = np.argsort(keys)
            keys, numbers = np.append(keys[by_key], np.iinfo(np.int64).max), np.append(by_key, -1)
            out = np.empty(max(0, len(stream) - 1), np.int32)
            for a in range(0, len(out), STRETCH):
                first, second = stream[a : a + STRETCH], stream[a + 1 : a + STRETCH + 1]
                first = first[: len(second)]
                pairs = np.where((first >= 0) & (second >= 0), first << 32 | second, -1)
                at = np.searchsorted(keys, pairs)
                out[a : a + len(pairs)] = np.where(keys[at] == pairs, numbers[at], -1)
            yield _stream(block, grp, out, known[rank])
            give_back()


def _with_ids(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Blocks with ``found``, the other columns of their rows of ``found`` as a list."""
    columns = [c for c in found.columns if c != "block"]
    lists = found.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("found"))
    none = F.array().cast(f"array<struct<{', '.join(f'{c}: bigint' for c in columns)}>>")
    return blocks.join(lists, "block", "left").select(*blocks.columns, F.coalesce("found", none).alias("found"))


def _ranked(counts: DataFrame, order: list) -> DataFrame:
    """Add ``id``: the rank by count within the group."""
    return cut(position(cut(counts, "phrase-counts"), ["grp"], [F.desc("n"), *order], "id"), "phrases")


def _known(pairs: DataFrame, least: int, size: int) -> DataFrame:
    """The rows of frequent pairs with the ``total`` of the pair and, for more than two words, an ``id`` that they share.

    The rows of a pair, at most one a block, meet once for that.
    """
    same = Window.partitionBy("grp", "left", "right")
    if size == 2:
        named, added = pairs, {}
    else:
        named, added = pairs.withColumn("row", F.monotonically_increasing_id()), {"id": F.min("row").over(same)}
    summed = named.withColumns({"total": F.sum("n").over(same), **added}).filter(F.col("total") >= least)
    return summed.select("block", "grp", "left", "right", *added, "total")


def phrase_levels(docs: DataFrame, group: Column, least: int, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each group, and the frequent phrases of 1 to ``longest`` words, each level a table.

    ``grp, id, n, words``, the counts of the first and of the last 1, 2, … words as ``heads`` and
    ``tails``, and the ids of what is left without the last and without the first word as ``left`` and ``right``.
    """
    # every text ends with the end of a piece
    text = F.concat(F.coalesce(F.col("text"), F.lit("")), F.lit(f" {END}"))
    source = docs.select(F.coalesce(group.cast("string"), F.lit("und")).alias("grp"), text.alias("text"))
    blocks, blocks_path = cut_to(
        source.mapInArrow(_blocks, "block long, grp string, words array<string>, counts array<long>, codes binary"), "phrase-blocks"
    )
    listed = blocks.select("block", "grp", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    listed = listed.select("block", "grp", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    words = listed.groupBy("grp", "word").agg(F.sum("n").alias("n"))
    in_block = F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n)
    totals = cut(blocks.groupBy("grp").agg(F.sum(in_block).alias("total")), "phrase-totals")
    frequent = _ranked(words.filter(F.col("n") >= least), ["word"])
    none = F.array().cast("array<long>")
    levels = [frequent.select("grp", "id", "n", F.array("word").alias("words"), none.alias("heads"), none.alias("tails"))]

    found = listed.join(frequent.select("grp", "word", "id"), ["grp", "word"]).select(
        "block", F.col("place").cast("long").alias("left"), "id"
    )
    coded = _with_ids(blocks.select("block", "grp", "codes"), found)
    # tables that the next level is made of; each goes once that level's streams are written
    spent = [blocks_path]
    for size in range(2, longest + 1):
        streams, streams_path = cut_to(coded.mapInArrow(_recode_words if size == 2 else _recode_pairs, _STREAM), "phrase-streams")
        for path in spent:
            remove_path(docs.sparkSession, path)
        spent = [streams_path]
        pairs = streams.mapInArrow(_neighbours, _PAIRS)
        if size < longest:
            known, known_path = cut_to(_known(pairs, least, size), "phrase-frequent")
            spent.append(known_path)
            # ids of words are ranks, below 2**32: those of a pair are its id
            own = F.expr("shiftleft(left, 32) | right") if size == 2 else F.first("id")
            ranked = known.groupBy("grp", "left", "right").agg(F.first("total").alias("n"), own.alias("id"))
            coded = _with_ids(streams, known.drop("grp"))
        else:
            # no block has to know its pairs any more
            ranked = pairs.groupBy("grp", "left", "right").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
            ranked = ranked.withColumn("id", F.monotonically_increasing_id())
        shorter = levels[-1]
        head = shorter.select("grp", F.col("id").alias("left"), "words", F.concat("heads", F.array("n")).alias("heads"))
        tail = shorter.select(
            "grp", F.col("id").alias("right"), F.element_at("words", -1).alias("last"), F.concat("tails", F.array("n")).alias("tails")
        )
        phrases = ranked.join(head, ["grp", "left"]).join(tail, ["grp", "right"])
        levels.append(
            cut(phrases.select("grp", "id", "n", F.concat("words", F.array("last")).alias("words"), "heads", "tails", "left", "right"), "phrases")
        )
    for path in spent:
        remove_path(docs.sparkSession, path)
    return totals, levels


def _lowest_cut() -> Column:
    """The cut of lowest score, of equal ones the first: ``score, k, l, r``. All products are decimals."""
    return F.expr(
        """array_min(transform(sequence(1, size(words) - 1), k -> named_struct(
          'score', (cast(1000000 as decimal(7, 0)) * (cast(n as decimal(15, 0)) * cast(n as decimal(15, 0))))
            div (cast(heads[k - 1] as decimal(15, 0)) * cast(tails[size(words) - k - 1] as decimal(15, 0))),
          'k', k, 'l', heads[k - 1], 'r', tails[size(words) - k - 1])))"""
    )


def collocations(docs: DataFrame, group: str = "lang", least: int = 10, longest: int = 3, share: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each group: ``grp, rank, phrase, a, l, r, n, score``.

    Phrases that occur ``least`` times are scored at the cut that binds them least. One goes if a
    phrase that holds it occurs ``share`` percent as often or more. ``n`` counts the words of the group.
    """
    totals, levels = phrase_levels(docs, F.col(group), least, longest)
    kept = None
    for size in range(2, longest + 1):
        phrases = levels[size - 1]
        if size < longest:
            # a phrase that is held by a longer one is held by one of one word more, at least as often
            holders = levels[size].select("grp", F.explode(F.array("left", "right")).alias("id"), F.col("n").alias("held"))
            phrases = phrases.join(holders.groupBy("grp", "id").agg(F.max("held").alias("held")), ["grp", "id"], "left")
            phrases = phrases.filter(F.col("held").isNull() | (F.col("held") * 100 < F.col("n") * share))
        scored = phrases.withColumn("cut", _lowest_cut()).select(
            "grp", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), "cut.l", "cut.r", "cut.score"
        )
        kept = scored if kept is None else kept.unionByName(scored)
    best = Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "grp").select("grp", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
