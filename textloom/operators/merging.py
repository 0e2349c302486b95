"""Rounds of merges of byte-pair training over a distributed table of words.

Words are strings with one character a symbol. A round takes the pairs that occur at least
``floor`` times, cuts all words between two symbols whose pair is rarer, and brings the
distinct pieces with their counts to the driver, never more than a stated number. On these
it merges one pair after another. That is exact down to ``floor``: a merge of ``a`` and ``b`` makes new
pairs of ``x`` and ``ab`` only where ``x`` and ``a`` were neighbours, so a pair that comes to ``floor``
never spans a cut. Then every word has its pieces exchanged, and the next round counts anew.

Counts of pairs halve many times from the first merge to the last, so rounds are few, however many
merges there are.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Batch:
    """Words of a batch, each of two symbols or more, end to end."""

    def __init__(self, words: Sequence[str]) -> None:
        self.text = "".join(words)
        codes = np.frombuffer(self.text.encode("utf-32-le"), np.uint32).astype(np.int64)
        self.ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        self.keys = codes[:-1] << 32 | codes[1:]
        self.inner = np.ones(len(self.keys), bool)
        self.inner[self.ends[:-1] - 1] = False

    def pairs(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs and how often they occur, if word ``i`` occurs ``n[i]`` times."""
        times = np.repeat(n, np.diff(self.ends, prepend=0))[:-1][self.inner]
        order = np.argsort(self.keys[self.inner], kind="stable")
        keys = self.keys[self.inner][order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[first], np.add.reduceat(times[order], first) if len(first) else times[:0]

    def pieces(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, start and end of each stretch of two or more symbols whose pairs are all in ``frequent``."""
        at = np.minimum(np.searchsorted(frequent, self.keys), len(frequent) - 1)
        joined = self.inner & (frequent[at] == self.keys)
        edges = np.concatenate([[0], np.flatnonzero(~joined) + 1, [len(self.text)]])
        far = np.diff(edges) > 1
        starts, ends = edges[:-1][far], edges[1:][far]
        return np.searchsorted(self.ends, starts, side="right"), starts, ends


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, Batch]]:
    for batch in batches:
        if batch.num_rows:
            words = batch.column("s").to_pylist()
            yield words, np.asarray(batch.column("n"), np.int64), Batch(words)


def pair_counts(words: DataFrame) -> DataFrame:
    """``pair, n``: neighbouring symbols of ``s, n`` as ``left << 32 | right``, added up per batch first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, n, batch in _batches(batches):
            keys, counts = batch.pairs(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    return words.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def piece_counts(words: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``piece, n``: distinct stretches of frequent pairs, added up per batch first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, n, batch in _batches(batches):
            found: dict[str, int] = defaultdict(int)
            owner, starts, ends = batch.pieces(frequent)
            for times, a, b in zip(n[owner].tolist(), starts.tolist(), ends.tolist()):
                found[batch.text[a:b]] += times
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["piece", "n"])

    return words.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def exchanged(words: DataFrame, frequent: np.ndarray, merged: Mapping[str, str]) -> DataFrame:
    """The words with each stretch of frequent pairs as the round left it; words of one symbol go."""
    shared = words.sparkSession.sparkContext.broadcast(merged)

    def exchange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, n, batch in _batches(batches):
            begins = (batch.ends - np.diff(batch.ends, prepend=0)).tolist()
            parts: dict[int, list[str]] = {}
            done: dict[int, int] = {}
            for i, a, b in zip(*(x.tolist() for x in batch.pieces(frequent))):
                piece = batch.text[a:b]
                new = shared.value[piece]
                if new != piece:
                    parts.setdefault(i, []).extend((batch.text[done.get(i, begins[i]) : a], new))
                    done[i] = b
            for i, text in parts.items():
                words[i] = "".join(text) + batch.text[done[i] : batch.ends[i]]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n)], ["s", "n"])

    return words.mapInArrow(exchange, "s string, n long").filter(F.length("s") > 1)


class Vocabulary:
    """Tokens in id order and the merges so far; bounded by ``size``."""

    def __init__(self, tokens: Sequence[str], size: int) -> None:
        self.tokens, self.size = list(tokens), size
        self.ids = {token: i for i, token in enumerate(tokens)}
        self.merges: list[tuple[str, str]] = []

    @property
    def full(self) -> bool:
        return len(self.tokens) >= self.size

    def merge(self, left: int, right: int) -> tuple[int, bool]:
        """Id of the merged token, and whether it is a new one."""
        token = self.tokens[left] + self.tokens[right]
        self.merges.append((self.tokens[left], self.tokens[right]))
        new = token not in self.ids
        if new:
            self.ids[token] = len(self.tokens)
            self.tokens.append(token)
        return self.ids[token], new


def _joined(parts: list[int], left: int, right: int, token: int) -> list[int]:
    out, i = [], 0
    while i < len(parts):
        if i + 1 < len(parts) and parts[i] == left and parts[i + 1] == right:
            out.append(token)
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return out


def merge_pieces(pieces: Sequence[tuple[list[int], int]], vocabulary: Vocabulary, floor: int, most: int | None = None) -> list[list[int]]:
    """Merge the most frequent pair again and again, ties by ids, while it occurs ``floor`` times.

    An index from pairs to pieces finds the pieces that change, and only their pairs are counted
    again. A merge whose token exists already ends the round: the same token may stand beyond a cut.
    """
    parts = [list(p) for p, _ in pieces]
    counts: dict[tuple[int, int], int] = defaultdict(int)
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, (symbols, n) in enumerate(pieces):
        for pair in zip(symbols, symbols[1:]):
            counts[pair] += n
            where[pair].add(i)
    queue = [(-n, *pair) for pair, n in counts.items()]
    heapq.heapify(queue)
    done = 0
    while queue and not vocabulary.full and done != most:
        n, left, right = heapq.heappop(queue)
        if counts[left, right] != -n:
            continue
        if -n < floor:
            break
        token, new = vocabulary.merge(left, right)
        changed = set()
        for i in where.pop((left, right)):
            old, times = parts[i], pieces[i][1]
            parts[i] = _joined(old, left, right, token)
            for pair in zip(old, old[1:]):
                counts[pair] -= times
                changed.add(pair)
            for pair in zip(parts[i], parts[i][1:]):
                counts[pair] += times
                where[pair].add(i)
                changed.add(pair)
        for pair in changed:
            if counts[pair] > 0:
                heapq.heappush(queue, (-counts[pair], *pair))
        done += 1
        if not new:
            break
    return parts
