"""Language identification by nearest clustered centroids.

A text is a bag of hashed letter bigrams and trigrams over lower-cased words, weighted by
1 + ln(tf) times idf and normalised. Each language has up to ``clusters`` centroids, found by
spherical k-means over a sample of its learnable texts; small clusters, mostly mislabelled texts,
are left out. A text takes the language of the centroid with the highest cosine, and is rejected
when even that one is farther away than nearly all texts of its language were in the sample.

The sample holds about ``rows`` texts of each language, or all if there are fewer: a bound of
the model, not of what is predicted. Counts of languages cover all rows. Every text is
predicted, and whole. Null texts and texts without a letter are ``und`` with score 0, and
so is everything if no language could be learned. Repeated rows are predicted alike. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import free_name, slices
from textloom.runtime import cut

UNKNOWN = "und"
#: Buckets of hashed n-grams, and characters taken at a time.
BUCKETS, _CHUNK = 1 << 12, 1 << 20
_ALPHA: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(np.array([chr(i).isalpha() for i in range(0x110000)], bool))
    return _ALPHA[0]


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)


def counts(text: str | None) -> np.ndarray | None:
    """Counts of a text's n-grams by bucket; None without a letter."""
    total, before = np.zeros(BUCKETS, np.int64), np.full(1, 32, np.uint64)
    seen = False
    for at in range(0, len(text or ""), _CHUNK):
        code = np.frombuffer(text[at : at + _CHUNK].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = _letters()[code]
        seen |= bool(is_letter.any())
        code = np.where(is_letter, code, 32).astype(np.uint64)
        code = np.concatenate([before, code] + ([[np.uint64(32)]] if at + _CHUNK >= len(text) else []))
        # runs of blanks count once
        code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]
        pair = (code[:-1] << np.uint64(21)) | code[1:]
        three = (pair[:-1] << np.uint64(21)) | code[2:]
        # pairs within what was carried over are counted already
        total += np.bincount(_bucket(pair[len(before) - 1 :]).astype(np.int64), minlength=BUCKETS)
        total += np.bincount(_bucket(three).astype(np.int64), minlength=BUCKETS)
        before = code[-2:]
    return total if seen else None


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def vectors(tallies: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows of count rows, in single precision and in place, as rows are wide."""
    weight = np.maximum(tallies, 1).astype(np.float32)
    np.log(weight, out=weight)
    weight += 1
    weight *= tallies > 0
    weight *= idf.astype(np.float32)
    weight /= np.maximum(np.linalg.norm(weight, axis=1, keepdims=True), 1e-12)
    return weight


def cluster(x: np.ndarray, clusters: int, rounds: int = 12, least_share: float = 0.08) -> np.ndarray:
    """Spherical k-means of the rows; centroids of clusters with too few rows are left out."""
    mean = _normal(x.mean(axis=0))
    k = min(clusters, len(x))
    # start from the mean and then whatever row is farthest from what is chosen
    centers, near = [mean], x @ mean
    while len(centers) < k:
        centers.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centers[-1])
    centers = np.array(centers)
    for _ in range(rounds):
        mine = (x @ centers.T).argmax(axis=1)
        centers = np.array([_normal(x[mine == c].mean(axis=0)) if (mine == c).any() else centers[c] for c in range(len(centers))])
    size = np.bincount((x @ centers.T).argmax(axis=1), minlength=len(centers))
    kept = centers[size >= least_share * len(x)]
    return kept if len(kept) else mean[None]


@dataclass
class Model:
    """What prediction needs: idf, centroids, and the language and the lowest cosine of each centroid."""

    idf: np.ndarray
    centers: np.ndarray
    langs: list[str]
    floors: np.ndarray


def fit(
    docs: DataFrame, learnable: Column, rows: int = 1500, clusters: int = 4, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> Model:
    """Learn from the rows where ``learnable`` holds and the language is known; about ``rows`` of each language."""
    usable = docs.filter(learnable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    # one number a language, as the model itself has, so that no text is moved to be drawn
    known = usable.groupBy(lang).count().collect()
    share = F.lit(0.0)
    if known:
        share = F.create_map(*[F.lit(v) for name, n in known for v in (name, min(1.0, rows / n))])[F.col(lang)]
    drawn = F.pmod(F.xxhash64(F.lit("language"), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = usable.filter(drawn < share).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            langs, where, how_many = [], [], []
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found = counts(body)
                if found is not None:
                    langs.append(name)
                    where.append(np.flatnonzero(found))
                    how_many.append(found[where[-1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(where, pa.list_(pa.int64())), pa.array(how_many, pa.list_(pa.int64()))],
                ["lang", "buckets", "counts"],
            )

    tallied = cut(sample.mapInArrow(tally, "lang string, buckets array<bigint>, counts array<bigint>"), "language-sample")
    # one row a bucket
    seen = tallied.select(F.explode("buckets").alias("b")).groupBy("b").count().collect()
    size = tallied.count()
    frequency = np.zeros(BUCKETS)
    for b, n in seen:
        frequency[b] = n
    idf = np.log((1 + size) / (1 + frequency)) + 1

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(group), BUCKETS), np.float32)
        for k, (where, how_many) in enumerate(zip(group["buckets"], group["counts"])):
            x[k, where] = how_many
        x = vectors(x, idf)
        centers = cluster(x, clusters)
        floor = float(np.quantile((x @ centers.T).max(axis=1), 0.001))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "center": [c.tolist() for c in centers], "floor": floor})

    # a group is one language's part of the sample, so it has a bound
    found = tallied.groupBy("lang").applyInPandas(learn, "lang string, center array<float>, floor double")
    found = sorted(found.collect(), key=lambda r: (r["lang"], r["center"]))
    return Model(
        idf,
        np.array([r["center"] for r in found], np.float32).reshape(-1, BUCKETS),
        [r["lang"] for r in found],
        np.array([r["floor"] for r in found]),
    )


def predict(docs: DataFrame, model: Model, text: str = "text", slack: float = 0.4) -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` (the cosine) and ``rejected``.

    Rejected are ``und`` and texts whose cosine is below ``slack`` times the one nearly all texts of
    that language reach in the sample. The three names get underscores in front where ``docs`` has such columns.
    """
    names = [free_name(docs, n) for n in ("lang_pred", "score", "rejected")]
    added = ", ".join(f"`{n}` {kind}" for n, kind in zip(names, ("string", "double", "boolean")))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 2 << 20):
            found = [counts(t.as_py()) for t in batch.column(text)]
            lang, score, rejected = [UNKNOWN] * len(found), np.zeros(len(found)), np.ones(len(found), bool)
            rows = [k for k, f in enumerate(found) if f is not None]
            for at in range(0, len(rows) if len(model.langs) else 0, 256):
                some = rows[at : at + 256]
                near = vectors(np.array([found[k] for k in some]), model.idf) @ model.centers.T
                best = near.argmax(axis=1)
                for k, b, n in zip(some, best.tolist(), near[np.arange(len(some)), best].tolist()):
                    lang[k], score[k], rejected[k] = model.langs[b], min(1.0, max(0.0, n)), n < slack * model.floors[b]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang), pa.array(score), pa.array(rejected)],
                [*batch.schema.names, *names],
            )

    return docs.mapInArrow(work, ", ".join([*fields, added]))


def keep_known(docs: DataFrame, learnable: Column, **options) -> DataFrame:
    """``docs`` without rejected rows."""
    model = fit(docs, learnable, **options)
    plain = docs.select(F.struct(*docs.columns).alias("row"), F.col(options.get("text", "text")).alias("text"))
    kept = predict(plain, model).filter(~F.col("rejected"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
