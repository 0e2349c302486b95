"""Document fingerprints by improved consistent weighted sampling, in DataFrame functions only.

A text is a weighted set: its words and how often each occurs. For each sample a word with
weight w draws r and c from Gamma(2, 1) and b from [0, 1) by hashing, takes the level
t = floor(ln w / r + b), and bids ln c - r (t - b) - r; the lowest bid is the sample. Two texts
share a sample with the probability of their generalised Jaccard similarity. A bid is a function of
word, level and sample, so equal bids stand for equal (word, level).

Documents are dealt to buckets, ranges of ids of about ``bucket_rows`` rows, by one shuffle. A bucket
also gets the first document of the bucket after it, so each document finds the next one in its
own task; counting words and finding the lowest bids keep that partitioning.

A null text is an empty text; texts without a word have the same fingerprint, of empty samples.
The order of documents is by descending id, null last; ties are put in order by text. Repeated
rows are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import text_key
from textloom.runtime import cut

#: Digits of a sample in the fingerprint.
_DIGITS = 8


def bid(term: Column, weight: Column, sample: int) -> Column:
    """The logarithm of a term's bid for a sample; null for a null term."""
    one, two = F.xxhash64(F.lit(2 * sample), term), F.xxhash64(F.lit(2 * sample + 1), term)

    def uniform(bits: Column, shift: int, width: int) -> Column:
        """The middle of one of 2 ** width equal parts of (0, 1)."""
        part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        return (part + F.lit(0.5)) * F.lit(2.0**-width)

    r = -F.ln(uniform(one, 43, 21) * uniform(one, 22, 21))
    b = uniform(one, 0, 22)
    c = -F.ln(uniform(two, 32, 32) * uniform(two, 0, 32))
    level = F.floor(F.ln(weight) / r + b)
    return F.when(term.isNotNull(), F.ln(c) - r * (level - b) - r)


def _bucket_of(key: Column, bounds: list) -> Column:
    """How many of the rising ``bounds`` are below ``key``, by binary search; -1 for a null key."""
    if not bounds:
        return F.when(key.isNull(), F.lit(-1)).otherwise(F.lit(0))
    inside = F.array(*map(F.lit, bounds))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(state: Column, _: Column) -> Column:
        lo, hi = state["lo"], state["hi"]
        middle = F.floor((lo + hi) / 2).cast("int")
        below = F.get(inside, F.least(middle, F.lit(len(bounds) - 1))) < key
        open_ = lo < hi
        return F.struct(
            F.when(open_ & below, middle + 1).otherwise(lo).alias("lo"), F.when(open_ & ~below, middle).otherwise(hi).alias("hi")
        )

    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(len(bounds) + 1)) + 1))
    return F.when(key.isNull(), F.lit(-1)).otherwise(F.aggregate(steps, start, halve)["lo"])


def in_buckets(docs: DataFrame, key: str, text: str, bucket_rows: int, most_buckets: int = 100_000) -> DataFrame:
    """``(bucket, first_of_next, key, text)``: every document, and in each bucket the document after its last one."""
    named = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = named.count()
    buckets = max(1, min(most_buckets, -(-rows // bucket_rows)))
    at = [k / buckets for k in range(1, buckets)]
    # the driver sees one id a bucket
    bounds = []
    if at:
        found = named.agg(F.percentile_approx("key", at, F.lit(max(10_000, 10 * buckets))).alias("b")).first()["b"]
        bounds = sorted(set(found or []))
    dealt = named.withColumn("bucket", _bucket_of(F.col("key"), bounds))

    # the first document of each bucket: its id, then its text
    heads = cut(dealt.groupBy("bucket").agg(F.max("key").alias("head")), "bucket-heads")
    behind = Window.orderBy(F.desc("bucket"))
    # one row a bucket; the bucket after the last is the first
    chain = heads.select("head", F.col("bucket").alias("from"), F.lag("bucket").over(behind).alias("to"))
    last = heads.agg(F.max("bucket").alias("top"), F.min("bucket").alias("low"))
    chain = chain.join(F.broadcast(last), F.lit(True)).select("head", F.coalesce("to", "low").alias("to"), "from")
    chain = cut(chain, "bucket-chain")
    # at most one id a bucket, so this side stays below the number of buckets
    first = named.join(F.broadcast(chain), F.col("key").eqNullSafe(F.col("head")))
    in_order = Window.partitionBy("to").orderBy(*text_key(F.col("text")))
    first = first.withColumn("nth", F.row_number().over(in_order)).filter("nth = 1")
    first = cut(first.select(F.col("to").alias("bucket"), F.lit(True).alias("first_of_next"), "key", "text"), "bucket-firsts")
    every = dealt.select("bucket", F.lit(False).alias("first_of_next"), "key", "text")
    return every.unionByName(first).repartition(buckets, "bucket")


def fingerprints(
    docs: DataFrame, samples: int = 32, key: str = "doc_id", text: str = "text", bucket_rows: int = 2000
) -> DataFrame:
    """Each document with its edited text's checksum, both fingerprints, and their likenesses.

    ``(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``. The edited text has the
    last half of the code points replaced by as many of the next document.
    """
    rows = in_buckets(docs, key, text, bucket_rows)
    order = [F.col("first_of_next"), F.col("key").desc_nulls_last(), *text_key(F.col("text"))]
    by_bucket = Window.partitionBy("bucket").orderBy(*order)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.char_length("text") - half),
        F.substring(F.coalesce("next", F.lit("")), F.lit(1), half),
    )
    placed = rows.select(
        "*", F.row_number().over(by_bucket).alias("place"), F.lead("text").over(by_bucket).alias("next")
    ).withColumn("edited", edited)

    about = placed.select(
        "bucket",
        "place",
        "key",
        "first_of_next",
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
    )
    both = placed.select(
        "bucket",
        "place",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("which"), F.col("text").alias("body")),
                F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")),
            )
        ).alias("v"),
    ).select("bucket", "place", "v.which", "v.body")
    words = both.select("bucket", "place", "which", F.explode(F.split("body", r"[\x20\x09-\x0D]+")).alias("word"))
    # an empty word stands for no word, so that every text keeps a row
    term = F.when(F.col("word") != "", F.xxhash64("word"))
    terms = words.select("bucket", "place", "which", term.alias("term"))
    weighed = terms.groupBy("bucket", "place", "which", "term").agg(F.count(F.lit(1)).cast("double").alias("w"))
    lowest = weighed.groupBy("bucket", "place", "which").agg(
        *[F.min(bid(F.col("term"), F.col("w"), k)).alias(f"s{k}") for k in range(samples)]
    )

    def digits(k: int) -> Column:
        mixed = F.hex(F.shiftrightunsigned(F.xxhash64(F.lit(k), F.col(f"s{k}")), 32))
        return F.when(F.col(f"s{k}").isNull(), F.lit("-" * _DIGITS)).otherwise(F.lower(F.lpad(mixed, _DIGITS, "0")))

    printed = lowest.select("bucket", "place", "which", F.concat(*[digits(k) for k in range(samples)]).alias("print"))
    pairs = printed.groupBy("bucket", "place").agg(
        F.max(F.when(F.col("which") == 0, F.col("print"))).alias("fingerprint"),
        F.max(F.when(F.col("which") == 1, F.col("print"))).alias("edited_fingerprint"),
    )
    after = Window.partitionBy("bucket").orderBy("place")
    pairs = pairs.withColumn("next_print", F.lead("fingerprint").over(after))
    return (
        about.join(pairs, ["bucket", "place"])
        .filter(~F.col("first_of_next"))
        .select(
            F.col("key").alias(key),
            "n_chars",
            "edited_sha256",
            "fingerprint",
            "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("next_print"), samples).alias("near_next"),
        )
    )


def likeness(a: Column, b: Column, samples: int) -> Column:
    """The share of samples in which two fingerprints agree."""
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(samples - 1)),
        F.lit(0),
        lambda n, k: n
        + (
            F.substring(a, k * _DIGITS + 1, F.lit(_DIGITS)) == F.substring(b, k * _DIGITS + 1, F.lit(_DIGITS))
        ).cast("int"),
    )
    return same / F.lit(float(samples))
