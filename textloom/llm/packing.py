"""Best-fit packing of token pieces into sequences, improved by bin completion.

Documents are cut only where they are longer than a sequence. Pieces are dealt at random
to groups of about ``group_rows``; a group packs its pieces by best-fit decreasing, and
where that needs more sequences than the bound it searches by bin completion: around the
longest piece left, fillings that no other filling dominates, those with the least waste
first, cut off as soon as their waste cannot lead below the best solution so far. The
search ends after ``nodes`` steps with the best packing found. About one sequence a
group is lost to the dealing when lengths spread smoothly, more when they are skewed.

A null text is an empty text: its piece holds the end id only. Repeated rows are
documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from operator import neg

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import slices
from textloom.llm.tokens import encoder, ended
from textloom.runtime import cut


#: Bytes of text encoded at a time.
SLICE = 2 << 20


def pieces(docs: DataFrame, tokenizer: str, end_id: int, room: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, piece, start, length, ids)``: the pieces of each document; ``ids`` are unsigned 32-bit little-endian."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids binary"

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        # words, ids and places of a slice take many times its text
        for batch in slices(batches, text, SLICE):
            flat, edges = ended(*encode(batch.column(text)), end_id)
            counts = -(-np.diff(edges) // room)
            row = np.repeat(np.arange(batch.num_rows), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            begin = edges[row] + piece * room
            length = np.minimum(edges[row + 1] - begin, room)
            raw = flat.astype("<u4").tobytes()
            ids = [raw[4 * a : 4 * (a + n)] for a, n in zip(begin.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(pa.array(row)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(piece * room),
                    pa.array(length),
                    pa.array(ids, pa.binary()),
                ],
                [key, "piece", "start", "length", "ids"],
            )

    return docs.select(key, text).mapInArrow(cut_up, schema)


def best_fit(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Best-fit decreasing: lists of lengths, one list a sequence."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(room + 1)]
    spaces = 0  # bit s: some sequence has exactly s free
    for n in sorted(lengths.tolist(), reverse=True):
        fits = spaces >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            at = by_space[space].pop()
            if not by_space[space]:
                spaces &= ~(1 << space)
        else:
            space, at = room, len(bins)
            bins.append([])
        bins[at].append(n)
        left = space - n
        if left:
            by_space[left].append(at)
            spaces |= 1 << left
    return bins


def least_bins(lengths: np.ndarray, room: int) -> int:
    """A bound from below: all tokens, and for each cut the pieces too long to share a sequence."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=room + 1)
    size = np.arange(room + 1)
    number, tokens = np.cumsum(count), np.cumsum(count * size)
    best = -(-int(lengths.sum()) // room)
    for small in np.flatnonzero(count[: room // 2 + 1]).tolist():
        # pieces above room - small are alone among those of at least small
        alone = int(number[room] - number[room - small])
        half = int(number[room - small] - number[room // 2])
        free = half * room - int(tokens[room - small] - tokens[room // 2])
        rest = int(tokens[room // 2] - (tokens[small - 1] if small else 0))
        best = max(best, alone + half + max(0, -(-(rest - free) // room)))
    return best


def fillings(space: int, sizes: list[int], count: list[int], most: int, budget: list[int]) -> list[list[int]]:
    """Sets of lengths that fit into ``space``, least waste first; none is dominated by one kept.

    ``sizes`` fall, ``count`` says how many pieces of each size are left. A set is dominated when another one
    piece longer fits in its waste, so only sets to which nothing more can be added are kept.
    """
    found: list[tuple[int, list[int]]] = []
    smallest = next((sizes[k] for k in range(len(sizes) - 1, -1, -1) if count[k]), space + 1)

    def extend(at: int, left: int, chosen: list[int]) -> bool:
        budget[0] -= 1
        if left < smallest or budget[0] <= 0:
            found.append((left, chosen))
            return left == 0
        k, took = max(at, bisect_left(sizes, -left, key=neg)), False
        while k < len(sizes):
            n = sizes[k]
            if count[k]:
                took = True
                count[k] -= 1
                full = extend(k, left - n, [*chosen, n])
                count[k] += 1
                if full or len(found) >= most or budget[0] <= 0:
                    return full
            k += 1
        if not took:
            found.append((left, chosen))
        return False

    extend(0, space, [])
    found.sort(key=lambda f: (f[0], [-n for n in f[1]]))
    return [chosen for _, chosen in found]


def complete_bins(lengths: np.ndarray, room: int, incumbent: list[list[int]], nodes: int) -> list[list[int]]:
    """Bin completion by depth-first branch and bound; ``incumbent`` unless a packing with fewer sequences is found."""
    best, bound = incumbent, least_bins(lengths, room)
    total = int(lengths.sum())
    sizes, counts = np.unique(lengths, return_counts=True)
    sizes, count = sizes[::-1].tolist(), counts[::-1].tolist()
    where = {n: k for k, n in enumerate(sizes)}
    budget = nodes
    # each level: the fillings not yet tried around its longest piece, and what stands in its sequence now
    stack: list[list] = []
    packed: list[list[int]] = []
    waste = 0

    def branch() -> bool:
        """Open a level; False when nothing is left to pack."""
        top = next((k for k, c in enumerate(count) if c), None)
        if top is None:
            return False
        count[top] -= 1
        options = fillings(room - sizes[top], sizes, count, 6, [80])
        count[top] += 1
        stack.append([[sizes[top], *o] for o in options][::-1])
        return True

    if not branch():
        return best
    while stack and budget > 0 and len(best) > bound:
        budget -= 1
        if len(packed) == len(stack):  # take back what this level tried before
            gone = packed.pop()
            waste -= room - sum(gone)
            for n in gone:
                count[where[n]] += 1
        if not stack[-1]:
            stack.pop()
            continue
        chosen = stack[-1].pop()
        spare = room - sum(chosen)
        # a better packing has at most this much room to waste
        if waste + spare > (len(best) - 1) * room - total:
            stack[-1].clear()
            continue
        packed.append(chosen)
        waste += spare
        for n in chosen:
            count[where[n]] -= 1
        if not branch():
            best = [list(b) for b in packed]
    return best


def pack_lengths(lengths: np.ndarray, room: int, nodes: int = 15_000) -> list[list[int]]:
    """Lengths of at most ``room`` as sequences; every length stands in exactly one."""
    full = int((lengths == room).sum())
    rest = lengths[lengths < room]
    found = best_fit(rest, room)
    if len(found) > least_bins(rest, room):
        found = complete_bins(rest, room, found, nodes)
    return [[room]] * full + found


def pack(rows: DataFrame, room: int, group_rows: int = 20_000, nodes: int = 15_000) -> DataFrame:
    """``rows`` (with ``length``) plus ``sequence_id`` and ``offset``.

    Rows are numbered and written first, so a lost task finds the same numbers again; only a number and the
    length of a row go to the tasks that pack.
    """
    numbered = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-numbered.count() // group_rows))
    dealt = numbered.select("_row", F.col("length").cast("bigint").alias("length"))
    dealt = dealt.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        bins = pack_lengths(lengths, room, nodes)
        taken = np.fromiter((n for b in bins for n in b), np.int64, len(lengths))
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        starts = np.concatenate([np.cumsum([0, *b[:-1]]) for b in bins]) if bins else np.zeros(0)
        # the k-th row of a length goes where the k-th such length stands
        order, stands = np.argsort(lengths, kind="stable"), np.argsort(taken, kind="stable")
        out = pd.DataFrame({"_row": group["_row"].to_numpy()[order]})
        out["sequence_id"] = int(group["_group"].iloc[0]) * (1 << 32) + number[stands]
        out["offset"] = starts[stands].astype(np.int64)
        return out

    placed = dealt.groupBy("_group").applyInPandas(place, "_row bigint, sequence_id bigint, offset bigint")
    return numbered.join(placed, "_row").drop("_row")


def packed(docs: DataFrame, tokenizer: str, end_id: int, room: int, key: str = "doc_id") -> DataFrame:
    """Pieces of ``docs`` with the checksum of their ids, packed."""
    rows = pieces(docs, tokenizer, end_id, room, key)
    return pack(rows.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), room)
