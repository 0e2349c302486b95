"""Exhaustive top-k inner products, term at a time.

A dimension is a term. Candidates are dealt to blocks; in a block each term has a posting
list of the vectors where it is not zero. A block of query rows walks its terms: the weight
times the posting list is added into dense score arrays, one cell for each query and
candidate of the block. A partition selection takes the best k of each block, and a ranking
over blocks merges them. Every query meets every candidate; scores are exact whole numbers.

Vectors that are null or hold null or non-finite components, and rows without id, take no
part; of rows that share an id the one with the smallest vector asks; missing trailing components count as zero, an empty vector scores zero. Ties go to the
smaller id, then to either of repeated rows. A query is not matched with rows of its own id.
Scores beyond a long stop at its ends. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.runtime import cut

_LONG = (1 << 63) - 1


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``(id, weights)``: each component x as floor(scale * x), as doubles, which hold such numbers exactly."""
    value = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull() & finite
    return vectors.filter(usable).select(
        F.col(key).cast("bigint").alias("id"),
        value.alias("weights"),
    )


def _matrix(rows: pd.Series) -> np.ndarray:
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def scores(queries: np.ndarray, terms: list[tuple[int, np.ndarray, np.ndarray]], candidates: int) -> np.ndarray:
    """Dense score arrays of query rows by term-at-a-time accumulation over posting lists."""
    total = np.zeros((len(queries), candidates), terms[0][2].dtype if terms else np.int64)
    for term, where, weight in terms:
        if term >= queries.shape[1]:
            break
        asking = np.flatnonzero(queries[:, term])
        if not len(asking):
            continue
        part = np.multiply.outer(queries[asking, term].astype(weight.dtype), weight)
        if len(asking) == len(queries) and len(where) == candidates:
            total += part
        else:
            total[np.ix_(asking, where)] += part
    return total


def _number_type(queries: np.ndarray, candidates: np.ndarray):
    """The narrowest type in which no score of the block can overflow."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, queries.shape[1])
    return np.int32 if most < 2**31 else np.int64 if most < 2**62 else object


def top_k(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    scale: float = 256.0,
    key: str = "vec_id",
    vector: str = "embedding",
    query_block: int = 4096,
    candidate_block: int = 4096,
) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` best candidates of each id divisible by ``every``."""
    is_query = F.col("id") % every == 0
    rows = cut(whole_numbers(vectors, key, vector, scale), "weights")
    asked = rows.filter(is_query.eqNullSafe(True)).groupBy("id").agg(F.min("weights").alias("weights"))
    numbers = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    c_blocks, q_blocks = max(1, -(-numbers[0] // candidate_block)), max(1, -(-numbers[1] // query_block))
    # every block of queries meets every block of candidates once
    dealt_c = rows.withColumn("c", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(c_blocks)).cast("int")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )
    dealt_q = asked.withColumn("q", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(q_blocks)).cast("int")).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))
    )

    def block(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "id": [], "score": []}).astype("int64")
        if not len(asking) or not len(there):
            return empty
        there = there.sort_values("id", kind="stable")
        ids, weights = there["id"].to_numpy(), _matrix(there["weights"])
        queries, names = _matrix(asking["weights"]), asking["id"].to_numpy()
        kind = _number_type(queries, weights)
        exact = (lambda a: np.vectorize(int, otypes=[object])(a)) if kind is object else (lambda a: a.astype(kind))
        terms = []
        for term in range(weights.shape[1]):
            where = np.flatnonzero(weights[:, term])
            if len(where):
                terms.append((term, where, exact(weights[where, term])))
        n, out = len(ids), []
        for at in range(0, len(names), 256):
            some = slice(at, at + 256)
            asks = exact(queries[some]) if queries.shape[1] else queries[some]
            total = scores(asks, terms, n)
            if kind is object:
                total = np.clip(total, -_LONG, _LONG)
            own = names[some, None] == ids[None, :]
            # the place breaks ties: candidates stand in order of id
            if kind is object:
                order = np.array([sorted(range(n), key=lambda j, r=r: (-int(total[r, j]), j))[: k + int(own[r].sum())] for r in range(len(total))], dtype=object)
                for r, places in enumerate(order):
                    places = [j for j in places if not own[r, j]][:k]
                    out.append((np.repeat(names[at + r], len(places)), ids[places], np.array([int(total[r, j]) for j in places])))
                continue
            ranked = total.astype(np.int64)
            low = -(1 << 62)
            ranked[own] = low
            take = min(k, n)
            # exact partition selection on (score, place), in two steps to stay within 64 bits
            cut_at = np.partition(ranked, n - take, axis=1)[:, n - take]
            for r in range(len(ranked)):
                above = np.flatnonzero(ranked[r] > cut_at[r])
                equal = np.flatnonzero(ranked[r] == cut_at[r])[: take - len(above)]
                places = np.concatenate([above, equal])
                places = places[ranked[r, places] > low]
                out.append((np.repeat(names[at + r], len(places)), ids[places], ranked[r, places]))
        if not out:
            return empty
        return pd.DataFrame({"query_id": np.concatenate([o[0] for o in out]), "id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out]).astype(np.int64)})

    best = dealt_q.groupBy("q", "c").cogroup(dealt_c.groupBy("q", "c")).applyInPandas(
        block, "query_id bigint, id bigint, score bigint"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
