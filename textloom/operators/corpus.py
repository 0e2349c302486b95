"""Excerpts, weighted mixtures, section headers, shares and train/validation splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as tx
from textloom.functions.numbers import draw
from textloom.operators.documents import usable
from textloom.runtime import position


def excerpts(books: DataFrame, lines: int = 1000, text: str = "text") -> DataFrame:
    """Keep the first ``lines`` lines of each book. A projection: no shuffle."""
    return books.withColumn(text, tx.first_lines(F.col(text), lines))


def mixture(code: DataFrame, books: DataFrame, code_weight: int = 3, book_lines: int = 1000) -> DataFrame:
    """Code repeated ``code_weight`` times, then one excerpt per book.

    Both inputs are ``(name, text)``. The result is ordered by ``(section, copy, name)``;
    its ``text`` is the bare text, see :func:`rendered` for headers.
    """
    copies = usable(code).select(
        F.lit(1).alias("section"),
        F.lit("code").alias("kind"),
        F.explode(F.sequence(F.lit(1), F.lit(code_weight))).alias("copy"),
        "name",
        "text",
    )
    sampled = excerpts(books, book_lines).select(
        F.lit(2).alias("section"), F.lit("book").alias("kind"), F.lit(1).alias("copy"), "name", "text"
    )
    return copies.unionByName(sampled)


def rendered(mixed: DataFrame, code_weight: int) -> DataFrame:
    """The mixture as corpus text pieces with headers, in ``(section, copy, place, name)`` order.

    Concatenating ``piece`` in that order gives the corpus file.
    """
    spark = mixed.sparkSession
    body = F.when(
        F.col("kind") == "code", F.concat(F.lit("# File: "), tx.basename(F.col("name")), F.lit("\n"))
    ).otherwise(
        F.concat(F.lit("\n# === BOOK EXCERPT: "), tx.basename(F.col("name")), F.lit(" ===\n\n"))
    )
    pieces = mixed.select(
        "section", "copy", F.lit(1).alias("place"), "kind", "name",
        F.concat(body, "text", F.lit("\n\n")).alias("piece"),
    )
    copy = (F.col("id") + 1).cast("int")
    marks = spark.range(code_weight).select(
        F.lit(1).alias("section"),
        copy.alias("copy"),
        F.explode(
            F.array(
                F.struct(
                    F.lit(0).alias("place"),
                    F.format_string(f"# === CODE SECTION %d/{code_weight} ===\n\n", copy).alias("piece"),
                ),
                F.struct(F.lit(2).alias("place"), F.lit("\n\n").alias("piece")),
            )
        ).alias("mark"),
    )
    return pieces.unionByName(
        marks.select(
            "section", "copy", "mark.place", F.lit("mark").alias("kind"), F.lit("").alias("name"), "mark.piece"
        )
    )


def shares(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Documents, characters and the real share of characters of each ``kind``."""
    per_kind = corpus.groupBy("kind").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.length(text).cast("bigint")).alias("chars")
    )
    # one row per kind is left, so the total needs no key
    everything = Window.partitionBy(F.lit(0))
    return per_kind.withColumn("share", F.col("chars") / F.sum("chars").over(everything))


def weight_for_share(code: DataFrame, books: DataFrame, target: float, book_lines: int = 1000) -> DataFrame:
    """The whole number of code copies that brings code closest to ``target`` of all characters.

    Sums are those of :func:`mixture`: usable code and excerpts.
    """
    sizes = mixture(code, books, 1, book_lines).select("kind", "text")
    totals = sizes.groupBy().agg(
        F.sum(F.when(F.col("kind") == "code", F.length("text"))).alias("code_chars"),
        F.sum(F.when(F.col("kind") == "book", F.length("text"))).alias("book_chars"),
    )
    exact = F.try_divide(F.col("book_chars") * target, F.col("code_chars") * (1.0 - target))
    share = lambda w: F.try_divide(w * F.col("code_chars"), w * F.col("code_chars") + F.col("book_chars"))
    low, high = F.greatest(F.floor(exact), F.lit(1)), F.greatest(F.ceil(exact), F.lit(1))
    nearer_low = F.abs(share(low) - target) <= F.abs(share(high) - target)
    return totals.withColumn("code_weight", F.when(nearer_low, low).otherwise(high)).withColumn(
        "code_share", share(F.col("code_weight"))
    )


def split_by_group(df: DataFrame, group: Column, fraction: float = 0.05, seed: int = 0) -> DataFrame:
    """Add ``part``; rows with an equal ``group`` (say, copies of one text) stay together."""
    return df.withColumn("part", F.when(draw(seed, group) < fraction, "validation").otherwise("train"))


def split_by_sample(
    df: DataFrame, key: str, fraction: float = 0.05, seed: int = 0, prefix_digits: int = 4
) -> DataFrame:
    """Add ``part`` with exactly ``floor(n * fraction)`` validation rows, by rank of a seeded hash.

    The rank is found without a global sort: rows are counted per hash prefix (at most
    ``16 ** prefix_digits`` rows), the prefix holding the last validation row follows from
    the running count, and only that prefix is ranked. The hash of that row is then a
    scalar every row is compared with.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    keys = hashed.select("_hash", F.substring("_hash", 1, prefix_digits).alias("_prefix"))
    counted = keys.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n"))
    in_order = Window.partitionBy(F.lit(0)).orderBy("_prefix")
    whole = Window.partitionBy(F.lit(0))
    edge = (
        counted.withColumn("_upto", F.sum("_n").over(in_order))
        .withColumn("_want", F.floor(F.sum("_n").over(whole) * F.lit(float(fraction))))
        .filter((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
        .select("_prefix", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_take"))
    )
    ranked = keys.join(F.broadcast(edge), "_prefix").withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_prefix").orderBy("_hash"))
    )
    last = ranked.filter("_rank = _take").agg(F.max("_hash")).scalar()
    return hashed.withColumn(
        "part", F.when(F.col("_hash") <= last, "validation").otherwise("train")
    ).drop("_hash")


def _ticket(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in a random but reproducible order."""
    return df.orderBy(_ticket(key, seed), key)


def shuffle_places(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Add ``place``, the position of each row in that order."""
    return position(df, [], [_ticket(key, seed), F.col(key)], "place")
