"""Token counts of whole texts, of any length, by a tokenizer file of a public library.

Short texts are encoded where they stand. A long text is cut into overlapping chunks that go
to any task, are encoded with offsets, and are spliced at a boundary that both neighbours
have: the tokens of the left chunk up to it and those of the right one from it.

A boundary is *proven stable* if no piece of the vocabulary contains the two characters it
stands between. Byte-pair merges join neighbours only, so none crosses it, and what stands on
one side has no part in the tokens of the other. An overlap without such a place is widened,
up to the end of the text if need be (a long run of one letter, say). Texts whose chunks still
share no boundary are put together again and encoded whole. Only sentencepiece BPE models
that take texts as they are (no normalisation, bytes for unknown characters) have such a
proof; texts of all other models are encoded whole.

A null text is an empty one and has no tokens; repeated rows are counted each; an empty table
gives an empty result; columns of ``docs`` come through unchanged, and a clash of names raises.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import output_schema, slices
from textloom.runtime import cut, shuffle_width

#: Characters of a chunk and of a first overlap; boundaries tried in an overlap.
CHUNK, OVERLAP, TRIED = 32_768, 256, 64

# Fields of a sentencepiece model file.
_TRAINER, _NORMALIZER, _MODEL_TYPE, _BPE, _BYTE_FALLBACK, _NAME, _CHARSMAP, _NO_EXTRA_BLANKS, _RULES = 2, 3, 3, 2, 35, 1, 2, 4, 6

_LOADED: dict[str, Counter] = {}


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and contents of the fields of a protocol buffer."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, message[at : at + size]
            at += size


class Counter:
    """Counts of one tokenizer file; ``pairs`` is None where no boundary can be proven stable."""

    def __init__(self, path: str) -> None:
        self.pairs = None
        if path.endswith(".json"):
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            with open(path) as file:
                rules = json.load(file) | {"truncation": None, "padding": None}
            tokenizer = Tokenizer.from_str(json.dumps(rules))
            self.ids = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids = lambda texts: model.encode(texts, num_threads=1, add_bos=False, add_eos=False)
        message = dict(_fields(model.serialized_model_proto()))
        trainer, normalizer = dict(_fields(message[_TRAINER])), dict(_fields(message[_NORMALIZER]))
        as_it_is = not normalizer.get(_CHARSMAP) and not normalizer.get(_RULES) and normalizer.get(_NO_EXTRA_BLANKS) == 0
        if trainer.get(_MODEL_TYPE) != _BPE or not trainer.get(_BYTE_FALLBACK) or not as_it_is:
            return
        every = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in every]
        apart = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in every]
        inside = {ord(a) << 32 | ord(b) for p, no in zip(pieces, apart) if not no for a, b in zip(p, p[1:])}
        self.pairs = np.array(sorted(inside), np.int64)
        # characters that a piece stands for; the first byte of a character stands for all of it
        self.width = np.array(
            [int(not 0x80 <= int(p[1:-1], 16) < 0xC0) if model.is_byte(i) else len(p) for i, p in enumerate(pieces)]
        )

    def stable(self, text: str) -> np.ndarray:
        """Places in the text that no piece can cover both sides of."""
        codes = np.frombuffer(text.replace(" ", "▁").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pairs = codes[:-1] << 32 | codes[1:]
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.flatnonzero(self.pairs[at] != pairs) + 1

    def before(self, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places at which a token begins, and how many tokens stand before them."""
        # the library puts a blank before the text
        begins = np.concatenate([[0], np.cumsum(self.width[ids])]) - 1
        at = np.minimum(np.searchsorted(begins, places), len(begins) - 1)
        there = begins[at] == places
        return places[there], at[there]


def counter(path: str) -> Counter:
    """The counter of a file, one per Python worker; every machine has the file at ``path``."""
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def chunks(text: str, counts: Counter, chunk: int, overlap: int) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """``(start, text, boundaries to splice at its head, at its tail)`` of overlapping chunks; places count from the text's start."""
    at, head = 0, np.zeros(0, np.int64)
    while True:
        end, wide = (int(head[-1]) if len(head) else 0) + chunk, overlap
        tail = counts.stable(text[end : end + wide])
        while not len(tail) and end + wide < len(text):
            wide *= 2
            tail = counts.stable(text[end : end + wide])
        if not len(tail):
            yield at, text[at:], head, tail
            return
        tail = tail[:TRIED] + end
        yield at, text[at : end + wide], head, tail
        at, head = end, tail


def _first_pass(path: str, chunk: int, overlap: int, kept: list[str]):
    """Counts of short texts, chunks of long ones, each long text under a key of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, key = counter(path), TaskContext.get().partitionId() << 40
        for part in slices(batches, "_text", 2 << 20):
            texts = part.column("_text").to_pylist()
            long = [len(t) > chunk + overlap and counts.pairs is not None for t in texts]
            ids = iter(counts.ids([t for t, far in zip(texts, long) if not far]))
            n, keys, rows = [None if far else len(next(ids)) for far in long], [], []
            for text, far in zip(texts, long):
                key += far
                keys.append(key if far else None)
                if far:
                    rows += [(key, *c) for c in chunks(text, counts, chunk, overlap)]
            schema = pa.schema([*[part.schema.field(c) for c in kept], *_PASS])
            columns = [*[part.column(c) for c in kept], pa.array(keys, pa.int64()), pa.array(n, pa.int64())]
            columns += [pa.nulls(len(n), f.type) for f in _PASS[2:]]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            for row in rows:
                columns = [pa.nulls(1, part.schema.field(c).type) for c in kept]
                columns += [pa.array([row[0]], pa.int64()), pa.nulls(1, pa.int64())]
                columns += [pa.array([v], f.type) for v, f in zip(row[1:], _PASS[2:])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


_PASS = [
    pa.field("_key", pa.int64()),
    pa.field("_tokens", pa.int64()),
    pa.field("_start", pa.int64()),
    pa.field("_chunk", pa.string()),
    pa.field("_head", pa.list_(pa.int64())),
    pa.field("_tail", pa.list_(pa.int64())),
]
_PASS_DDL = "_key long, _tokens long, _start long, _chunk string, _head array<long>, _tail array<long>"
_CHUNKED = "_key long, _start long, _n long, _head array<long>, _head_n array<long>, _tail array<long>, _tail_n array<long>"


def _encode_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for part in slices(batches, "_chunk", 2 << 20):
            rows, out = part.to_pylist(), []
            for row, ids in zip(rows, counts.ids([r["_chunk"] for r in rows])):
                ids, start = np.array(ids, np.int64), row["_start"]
                head, head_n = counts.before(ids, np.array(row["_head"], np.int64) - start)
                tail, tail_n = counts.before(ids, np.array(row["_tail"], np.int64) - start)
                out.append((row["_key"], start, len(ids), head + start, head_n, tail + start, tail_n))
            if out:
                types = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 4
                names = [x.split()[0] for x in _CHUNKED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names)

    return run


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            for key, text in zip(batch.column("_key").to_pylist(), batch.column("_text").to_pylist()):
                yield pa.RecordBatch.from_pydict({"_key": [key], "_total": [len(counts.ids([text])[0])]})

    return run


def _spliced(encoded: DataFrame) -> DataFrame:
    """``_key, _total``: tokens of each long text; null where two neighbours have no boundary in common."""
    after = Window.partitionBy("_key").orderBy("_start")
    seam = encoded.select(
        "_key", "_n", "_tail", "_tail_n", F.lead("_head").over(after).alias("_next"), F.lead("_head_n").over(after).alias("_next_n")
    )
    place = F.get(F.array_intersect("_tail", "_next"), F.lit(0))
    left = F.get("_tail_n", (F.array_position("_tail", place) - 1).cast("int"))
    skipped = F.get("_next_n", (F.array_position("_next", place) - 1).cast("int"))
    # without a common boundary the sum lacks a term, hence the count of such seams
    part = F.when(F.col("_next").isNull(), F.col("_n")).otherwise(left - skipped)
    return seam.select("_key", part.alias("_part")).groupBy("_key").agg(
        F.when(F.count("_part") == F.count(F.lit(1)), F.sum("_part")).alias("_total")
    )


def token_counts(docs: DataFrame, path: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Add ``n_tokens`` of the tokenizer file ``path`` (``.json``: tokenizers, ``.model``: sentencepiece) and ``n_bytes``; ``text`` goes."""
    kept = [c for c in docs.columns if c != text]
    if clash := {c.lower() for c in kept} & {"n_tokens", "n_bytes", "_text", "_bytes", "_total", *(f.name for f in _PASS)}:
        raise ValueError(f"columns of these names are in the way: {sorted(clash)}")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.octet_length(body).cast("long").alias("_bytes"), body.alias("_text"))
    kept = [*kept, "_bytes"]
    schema = output_schema(source, kept, _PASS_DDL)
    first = cut(source.mapInArrow(_first_pass(path, chunk, overlap, kept), schema), "token-chunks")

    rows = first.filter("_start IS NULL")
    pieces = first.filter("_start IS NOT NULL").select("_key", "_start", "_chunk", "_head", "_tail")
    # long texts are spread: neighbours need not meet before they are encoded
    spread = pieces.repartition(shuffle_width(docs.sparkSession), "_key", "_start")
    totals = cut(_spliced(spread.mapInArrow(_encode_chunks(path), _CHUNKED)), "token-totals")
    lost = totals.filter("_total IS NULL").select("_key")
    if not lost.isEmpty():
        # what a chunk adds to the one before it; a row holds the text that a row of docs held
        after = Window.partitionBy("_key").orderBy("_start")
        own = F.coalesce(F.lead("_start").over(after) - F.col("_start"), F.char_length("_chunk")).cast("int")
        core = pieces.join(lost, "_key", "left_semi").select("_key", "_start", F.substring("_chunk", F.lit(1), own).alias("_chunk"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_start", "_chunk"))), lambda s: s["_chunk"]), "")
        again = core.groupBy("_key").agg(joined.alias("_text")).mapInArrow(_whole(path), "_key long, _total long")
        totals = totals.filter("_total IS NOT NULL").unionByName(cut(again, "token-totals"))
    return rows.join(totals, "_key", "left").select(
        *[F.col(f"`{c}`") for c in kept if c != "_bytes"],
        F.col("_bytes").alias("n_bytes"),
        F.coalesce("_tokens", "_total").alias("n_tokens"),
    )
