"""Global token positions, next-token windows and the train/validation overlap audit."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.runtime import running


def token_offsets(docs: DataFrame, order: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """``(*order, n_tokens, start)``: where each document begins in the one token stream.

    Only the order columns and the token counts are moved, never the tokens.
    """
    sizes = docs.select(*order, F.size(tokens).cast("bigint").alias("n_tokens"))
    return running(sizes, [], list(order), {"start": ("sum", F.col("n_tokens"))})


def token_stream(docs: DataFrame, order: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """One row per token: ``(pos, *order, token)``."""
    placed = docs.join(token_offsets(docs, order, tokens), list(order))
    return placed.select(
        *order, "start", F.posexplode(tokens).alias("_i", "token")
    ).select((F.col("start") + F.col("_i")).alias("pos"), *order, "token")


def shifted(tokens: Column) -> tuple[Column, Column]:
    """Inputs and next-token targets of one token list."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.slice(tokens, 1, n), F.slice(tokens, 2, n)


def _width(block: int, bucket: int | None) -> int:
    width = bucket or max(4096, 8 * block)
    if width < block + 1:
        raise ValueError("bucket must hold at least block + 1 tokens")
    return width


def _buckets(docs: DataFrame, order: Sequence[str], block: int, tokens: str, width: int) -> DataFrame:
    """``bucket, stream``: the tokens at ``width`` positions of the stream and the ``block + 1`` after them."""
    halo = block + 1
    placed = docs.select(*order, tokens).join(token_offsets(docs, order, tokens), list(order))
    first = F.floor(F.greatest(F.col("start") - halo, F.lit(0)) / width)
    last = F.floor((F.col("start") + F.col("n_tokens") - 1) / width)
    pieces = (
        placed.filter("n_tokens > 0")
        .select("start", "n_tokens", tokens, F.explode(F.sequence(first, last)).alias("bucket"))
        .withColumn("low", F.greatest(F.col("start"), F.col("bucket") * width))
        .withColumn(
            "high", F.least(F.col("start") + F.col("n_tokens"), (F.col("bucket") + 1) * width + halo)
        )
        .filter("low < high")
        .select(
            "bucket",
            F.struct(
                "low",
                F.slice(
                    tokens,
                    (F.col("low") - F.col("start") + 1).cast("int"),
                    (F.col("high") - F.col("low")).cast("int"),
                ).alias("part"),
            ).alias("piece"),
        )
    )
    stream = F.flatten(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p.part))
    return pieces.groupBy("bucket").agg(stream.alias("stream"))


def _bucket_rows(docs: DataFrame, order: Sequence[str], block: int, tokens: str, bucket: int | None) -> tuple[DataFrame, Window]:
    """A row a token of a bucket, ``bucket, _i, token``, with ``start``, the position, and ``_own``, whether a window begins there."""
    width = _width(block, bucket)
    buckets = _buckets(docs, order, block, tokens, width)
    last = F.least(F.lit(width - 1), F.size("stream") - block - 2)
    rows = buckets.select("bucket", last.alias("_last"), F.posexplode("stream").alias("_i", "token"))
    start = F.col("bucket") * width + F.col("_i")
    return rows.select("bucket", "_i", "token", start.alias("start"), (F.col("_i") <= F.col("_last")).alias("_own")), Window.partitionBy("bucket").orderBy("_i")


def samples(
    docs: DataFrame,
    order: Sequence[str],
    block: int = 128,
    stride: int | None = None,
    tokens: str = "tokens",
    bucket: int | None = None,
) -> DataFrame:
    """``(start, x, y)`` windows of the whole token stream, documents joined in ``order``.

    Starts are the multiples of ``stride`` (default ``block``; 1 gives every window) up to
    ``n - block - 2``: the last possible window is left out, as the window count
    ``n - block - 1`` says.

    The stream is cut into buckets of ``bucket`` positions. Each document sends slices of
    its token list to the buckets it meets; a bucket also gets the next ``block + 1``
    tokens, so windows never look outside and a task holds one bounded bucket at a time.
    """
    stride = stride or block
    width = _width(block, bucket)
    buckets = _buckets(docs, order, block, tokens, width)

    begin = F.col("bucket") * width
    first_start = F.ceil(begin / stride) * stride
    last_start = F.least(begin + width - 1, begin + F.size("stream") - block - 2)
    return (
        buckets.withColumn("_from", first_start)
        .withColumn("_to", last_start)
        .filter("_from <= _to")
        .select("bucket", "stream", F.explode(F.sequence("_from", "_to", F.lit(stride).cast("bigint"))).alias("start"))
        .select(
            "start",
            F.slice("stream", (F.col("start") - begin + 1).cast("int"), block).alias("x"),
            F.slice("stream", (F.col("start") - begin + 2).cast("int"), block).alias("y"),
        )
    )


def window_sums(docs: DataFrame, order: Sequence[str], block: int, sign: Column, tokens: str = "tokens", bucket: int | None = None) -> DataFrame:
    """``start, x_sum, x_places, y_sum, y_places`` of the window at every start.

    ``sign`` is a whole number of a column ``token``; ``x_places`` adds each sign times its place in the window. Totals
    run over a bucket once and windows are differences of two of them, so no token is repeated.
    """
    rows, here = _bucket_rows(docs, order, block, tokens, bucket)
    rows = rows.withColumn("_s", sign.cast("bigint"))
    none, i = F.lit(0).cast("bigint"), F.col("_i").cast("bigint")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {"_c": F.coalesce(F.sum("_s").over(before), none), "_w": F.coalesce(F.sum(i * F.col("_s")).over(before), none)}
    )

    def difference(column: str, first: int) -> Column:
        begins = F.lead(column, first).over(here) if first else F.col(column)
        return F.lead(column, first + block).over(here) - begins

    found = rows.select(
        "start", "_own", i.alias("_i"), *[difference(c, k).alias(f"{c}{k}") for c in ("_c", "_w") for k in (0, 1)]
    ).filter("_own")
    return found.select(
        "start",
        F.col("_c0").alias("x_sum"),
        (F.col("_w0") - F.col("_i") * F.col("_c0")).alias("x_places"),
        F.col("_c1").alias("y_sum"),
        (F.col("_w1") - (F.col("_i") + 1) * F.col("_c1")).alias("y_places"),
    )


# Parameters of the window hashes: a prime whose products fit 64 bits, and a base for each hash.
PRIME, BASES = 2**31 - 1, (48_271, 69_621, 39_373)


def window_hashes(docs: DataFrame, order: Sequence[str], block: int, tokens: str = "tokens", bucket: int | None = None) -> DataFrame:
    """``start, h1, h2, h3``: rolling polynomial hashes of the ``block`` tokens at every start, 93 bits in all.

    A token counts its hash times a power of the base; running totals of a bucket give every window as one difference,
    which a power brings to the same degree everywhere.
    """
    rows, here = _bucket_rows(docs, order, block, tokens, bucket)
    span = _width(block, bucket) + block + 1
    names = [f"h{k + 1}" for k in range(len(BASES))]
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    powers = {}
    for name, base in zip(names, BASES):
        listed = [1]
        for _ in range(span):
            listed.append(listed[-1] * base % PRIME)
        powers[name] = F.from_json(F.lit(json.dumps(listed)), "array<bigint>")
    prime = F.lit(PRIME).cast("bigint")
    for k, name in enumerate(names):
        term = F.pmod(F.pmod(F.xxhash64(F.lit(k), "token"), prime) * F.get(powers[name], F.col("_i")), prime)
        rows = rows.withColumn(f"_t_{name}", term)
    rows = rows.withColumns({f"_c_{n}": F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0).cast("bigint")) for n in names})
    # totals of a bucket stay far below 2**63
    parts = {f"_d_{n}": F.pmod(F.lead(f"_c_{n}", block).over(here) - F.col(f"_c_{n}"), prime) for n in names}
    found = rows.select("start", "_i", "_own", *[c.alias(n) for n, c in parts.items()]).filter("_own")
    return found.select("start", *[F.pmod(F.col(f"_d_{n}") * F.get(powers[n], span - F.col("_i")), prime).alias(n) for n in names])


def window_overlap(split: DataFrame, order: Sequence[str], block: int = 128, part: str = "part", tokens: str = "tokens") -> DataFrame:
    """Windows of the validation stream whose tokens also are a window of the training stream, and the others.

    Each part is a stream of its own. Windows seldom repeat inside a task, so they are dealt by hash as they are and counted
    there. A window is two whole numbers: two hashes in one, the third and whether it is of the training stream in the other.
    """
    sides = None
    for name in ("train", "validation"):
        hashes = window_hashes(split.filter(F.col(part) == name), order, block, tokens)
        third = F.shiftleft("h3", 1) + F.lit(int(name == "train"))
        packed = hashes.select((F.shiftleft("h1", 31) + F.col("h2")).alias("k"), third.alias("third"))
        sides = packed if sides is None else sides.unionByName(packed)
    trained = F.col("third") % 2 == 1
    both = sides.repartition("k").groupBy("k", F.shiftright("third", 1).alias("h3")).agg(
        F.count_if(~trained).alias("validation"), F.bool_or(trained).alias("trained")
    )
    leaked = F.when(F.col("trained"), F.col("validation")).otherwise(0)
    return both.agg(F.coalesce(F.sum("validation"), F.lit(0)).alias("validation"), F.coalesce(F.sum(leaked), F.lit(0)).alias("leaked")).withColumn(
        "clean", F.col("validation") - F.col("leaked")
    )


def dataset_size(docs: DataFrame, block: int = 128, tokens: str = "tokens") -> DataFrame:
    """Tokens and stride-1 windows of the whole stream."""
    return docs.agg(F.coalesce(F.sum(F.size(tokens).cast("bigint")), F.lit(0)).alias("tokens")).withColumn(
        "samples", F.greatest(F.col("tokens") - block - 1, F.lit(0))
    )


def within_length(docs: DataFrame, limit: int = 1024, ids: str = "ids") -> DataFrame:
    """Add ``too_long`` for token lists above the model's sequence length."""
    return docs.withColumn("too_long", F.size(ids) > limit)


def scorable(docs: DataFrame, ids: str = "ids") -> DataFrame:
    """Drop token lists that have no next token."""
    return docs.filter(F.size(ids) >= 2)


def blocks(docs: DataFrame, limit: int = 1024, ids: str = "ids") -> DataFrame:
    """Cut each token list into consecutive blocks of at most ``limit`` tokens."""
    at = F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1)), F.lit(limit))
    return docs.filter(F.size(ids) > 0).select(
        "*", F.posexplode(at).alias("block_no", "_at")
    ).withColumn(ids, F.slice(ids, F.col("_at"), limit)).drop("_at")


def split_overlap(split: DataFrame, content: Column, part: str = "part") -> DataFrame:
    """Validation rows that also occur in the training rows, and those that do not.

    Equal content is counted per side first, so a text with many copies is one row when
    the sides meet.
    """
    key = F.xxhash64(content), F.md5(content.cast("string"))
    sides = split.select(F.col(part).alias("part"), key[0].alias("h"), key[1].alias("m")).groupBy(
        "part", "h", "m"
    ).agg(F.count(F.lit(1)).alias("n"))
    both = sides.groupBy("h", "m").agg(
        F.sum(F.when(F.col("part") == "validation", F.col("n")).otherwise(0)).alias("validation"),
        F.sum(F.when(F.col("part") == "train", F.col("n")).otherwise(0)).alias("train"),
    )
    leaked = F.when(F.col("train") > 0, F.col("validation")).otherwise(0)
    return both.agg(
        F.sum("validation").alias("validation"),
        F.sum(leaked).alias("leaked"),
        (F.sum("validation") - F.sum(leaked)).alias("clean"),
    )


def unleaked(validation: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """Validation rows whose key no training row has."""
    return validation.join(train.select(key).distinct(), key, "left_anti")
