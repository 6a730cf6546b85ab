"""Operator 4: exact top-k inner products by exhaustive term-at-a-time accumulation.

Components are quantised to integers, so a vector is a sparse row of (term,
weight) with the dimension as term. Rows are dealt into candidate stripes and
query stripes; a task holds one stripe of each. It turns the candidates into
postings (term -> rows, weights), and for every query scatters the weighted
postings of the query's own terms into a dense array of scores, selects the k
best of the stripe by partition, and Spark merges the stripes' selections.

Nothing is pruned, so results are exact. Both stripes have bounded sizes; a
stated set of queries meets all rows in blocks.

Defined cases: vectors that are null or hold a null or non-finite component
take no part; a vector of another length has zeros beyond its end; an empty
vector scores 0; ties go to the smaller id, a null id last; every row is a
candidate of its own, and a query of its own if the condition holds for it, also
where rows repeat an id or have none: only the query's own row is left out; an
empty table gives an empty result. Scores beyond a long raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgscreen.llm.common import runs, stash

SCALE = 256
K = 5
#: Rows of a stripe. A task holds both, 16 MB of postings, 16 MB of queries and one array of scores: candidates are
#: copied once per stripe of queries, so these are as large as a task's memory allows.
CANDIDATE_STRIPE, QUERY_STRIPE = 8192, 16384


def _sparse(cells: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the non-zero weights, sorted by term and row."""
    lengths = np.array([len(x) for x in cells], dtype=np.int64)
    weight = np.concatenate([np.asarray(x, dtype=np.int64) for x in cells]) if lengths.sum() else np.zeros(0, np.int64)
    if len(weight) and float(np.abs(weight).max()) ** 2 * max(1, lengths.max()) >= 2.0**63:
        raise OverflowError("an inner product of these vectors may not fit a long")
    row = np.repeat(np.arange(len(cells)), lengths)
    term = np.arange(len(weight)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.flatnonzero(weight)
    at = at[np.lexsort((row[at], term[at]))]
    return row[at], term[at], weight[at]


def best_of_stripe(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """The k best candidates of each query in this stripe."""
    ids, own = candidates[["nameless", "id"]].to_numpy(dtype=np.int64), candidates["row"].to_numpy(dtype=np.int64)
    row, term, weight = _sparse(candidates["vector"])
    width = int(term.max()) + 1 if len(term) else 0
    ends = np.searchsorted(term, np.arange(width + 1))
    postings = [(row[a:b], weight[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    qrow, qterm, qweight = _sparse(queries["vector"])
    by_query = np.argsort(qrow, kind="stable")
    qends = np.searchsorted(qrow[by_query], np.arange(len(queries) + 1))
    for q, query in enumerate(queries["row"].tolist()):
        scores = np.zeros(len(ids), dtype=np.int64)
        for i in by_query[qends[q]:qends[q + 1]]:
            if qterm[i] < width:
                rows, weights = postings[qterm[i]]
                scores[rows] += qweight[i] * weights
        others = np.flatnonzero(own != query)
        if len(others) > k:
            kth = np.partition(scores[others], len(others) - k)[len(others) - k]
            others = others[scores[others] >= kth]
        best = others[np.lexsort((ids[others, 1], ids[others, 0], -scores[others]))[:k]]
        if len(best):
            yield pd.DataFrame({"query": query, "nameless": ids[best, 0], "id": ids[best, 1], "score": scores[best]})


def top_k(vectors: DataFrame, is_query, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each row where the Column ``is_query`` holds."""
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector"), is_query.alias("asks"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vector").isNotNull() & fine)
    v = v.select(F.monotonically_increasing_id().alias("row"), F.col("id").isNull().cast("long").alias("nameless"), F.coalesce("id", F.lit(0)).alias("id"),
                 F.coalesce("asks", F.lit(False)).alias("asks"), F.transform("vector", lambda x: F.floor(x * SCALE).cast("long")).alias("vector"))
    v = stash(v, "topk")
    sizes = v.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    n_c, n_q = -(-sizes.n // CANDIDATE_STRIPE) or 1, -(-sizes.q // QUERY_STRIPE) or 1
    lot = F.xxhash64("row")
    carried = ["row", "nameless", "id", "vector"]
    candidates = v.select(F.lit(1).alias("side"), F.pmod(lot, F.lit(n_c)).cast("int").alias("c"),
                          F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"), *carried)
    queries = v.where("asks").select(F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("c"),
                                     F.pmod(lot, F.lit(n_q)).cast("int").alias("q"), *carried)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, cell in runs(batches, ["c", "q"]):
            yield from best_of_stripe(cell[cell["side"] == 0], cell[cell["side"] == 1], k)

    found = (queries.unionByName(candidates).repartition(n_c * n_q, "c", "q").sortWithinPartitions("c", "q", "side", "row")
             .mapInPandas(search, "query long, nameless long, id long, score long"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "nameless", "id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return (found.join(v.where("asks").select(F.col("row").alias("query"), F.col("id").alias("query_id")), "query")
            .select("query_id", "rank", F.when(F.col("nameless") == 0, F.col("id")).alias("vec_id"), "score"))
