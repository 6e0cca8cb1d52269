"""Operator 2: exact top-k by branch and bound over columns.

Vectors are packed into blocks that hold one dimension after the other (vertical layout). A task
takes a block of candidates and a block of queries and adds up inner products a few dimensions at
a time, those of the largest mass over the block's queries first. After each step the k candidates
with the highest sums get their exact scores, of which the k-th is a threshold. A candidate's score can
still change by at most the product of the two remaining masses (Cauchy-Schwarz): where that can't
reach the threshold it is dropped, and the columns of the survivors are compacted. What survives
all steps has its exact score. Each pair of blocks gives k rows per query; a window over these,
small, rows ranks them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need

CANDIDATES, QUERIES, STEP = 4096, 512, 8
#: Candidates that a key of the join holds, so how often the queries are sent; keys at least.
CUT, CUTS = 1 << 17, 32
RESULT = "query_id long, rank int, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v (array of long) of the rows that take part."""
    x = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    whole = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return need(vectors, "vec_id", "embedding").where(whole & finite).select("vec_id", x.alias("v"))


def _pack(block: int):
    """Rows to blocks: ids and the vertical matrix, as bytes; blocks hold one group and one number of dimensions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list] = {}

        def out(key: tuple[int, int]) -> pd.DataFrame:
            ids, vs = zip(*held.pop(key), strict=True)
            matrix = np.ascontiguousarray(np.asarray(vs, np.int64).reshape(len(ids), key[1]).T)
            return pd.DataFrame({"group": [key[0]], "dim": [key[1]], "ids": [np.asarray(ids, np.int64).tobytes()], "matrix": [matrix.tobytes()]})

        for batch in batches:
            for group, name, v in zip(batch["group"], batch["vec_id"], batch["v"], strict=True):
                key = (group, len(v))
                rows = held.setdefault(key, [])
                rows.append((name, v))
                if len(rows) >= block:
                    yield out(key)
        for key in list(held):
            yield out(key)

    return run


def _exact(query: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where these hold every sum exactly."""
    if matrix.size and len(query) and float(np.abs(query).max()) * float(np.abs(matrix).max()) * len(query) < 2.0**53:
        return (query.astype(float) @ matrix.astype(float)).astype(np.int64)
    return query @ matrix


def search_block(ids: np.ndarray, matrix: np.ndarray, query_id: int, query: np.ndarray, k: int, floats: np.ndarray, mass: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """ids and scores of the k best candidates of a block, ties to smaller ids, and how many survived each step.

    matrix: int64, a row for each dimension, the query's in the same order. floats: the same in doubles;
    mass: the running sums of its squares from the last dimension back.
    """
    d = len(query)
    q = query.astype(float)
    rest = np.sqrt(np.append(np.cumsum((q**2)[::-1])[::-1], 0.0))
    alive, survivors, threshold = np.flatnonzero(ids != query_id), [], -np.inf
    part = np.zeros(len(alive))
    for at in range(0, d, step):
        to = min(d, at + step)
        part = part + q[at:to] @ (floats[at:to] if len(alive) == len(ids) else floats[at:to, alive])
        if to < d and len(alive) > k:
            seeds = alive[np.argpartition(part, len(part) - k)[len(part) - k :]]
            threshold = max(threshold, float(_exact(query, matrix[:, seeds]).min()))
            slack = rest[to] * np.sqrt(mass[to, alive])
            # the margins cover the rounding of doubles
            keep = part + slack * (1 + 1e-9) + np.abs(part) * 1e-9 + 1e-6 >= threshold - abs(threshold) * 1e-9
            if not keep.all():
                alive, part = alive[keep], part[keep]
        survivors.append(len(alive))
    score = _exact(query, matrix[:, alive])
    best = np.lexsort((ids[alive], -score))[:k]
    return ids[alive][best], score[best], survivors


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, ids, matrix, q_ids, queries in zip(batch["dim"], batch["ids"], batch["matrix"], batch["q_ids"], batch["queries"], strict=True):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                matrix = np.frombuffer(matrix, np.int64).reshape(d, len(ids))
                queries = np.frombuffer(queries, np.int64).reshape(d, len(q_ids))
                order = np.argsort(-(queries.astype(float) ** 2).sum(axis=1), kind="stable")
                matrix, queries = np.ascontiguousarray(matrix[order]), queries[order]
                floats = matrix.astype(float)
                mass = np.vstack([np.cumsum((floats**2)[::-1], axis=0)[::-1], np.zeros((1, len(ids)))])
                out = [(q, *search_block(ids, matrix, q, queries[:, j], k, floats, mass)) for j, q in enumerate(q_ids)]
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat(q_ids, [len(o[1]) for o in out]),
                        "vec_id": np.concatenate([o[1] for o in out]) if out else np.empty(0, np.int64),
                        "score": np.concatenate([o[2] for o in out]) if out else np.empty(0, np.int64),
                    }
                )

    return run


def exact_topk(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, block: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors for each whose vec_id is divisible by `every`.

    vectors: vec_id, embedding. A component x counts as floor(scale * x). Rows that are null, or
    hold null or non-finite components, take no part, nor do rows without vec_id. A query meets
    the vectors of its own length only, never those of its own vec_id. A vec_id in several rows is
    a candidate by each of them and one query, ranked over the scores of all its different vectors.
    Ties go to smaller vec_ids. An empty table gives an empty result; extra columns, whatever their names, are not read.

    Queries are dealt to groups of about `query_block`, candidates to blocks of up to `block`, and the blocks
    to cuts of about CUT candidates. A candidate is shuffled once; the queries, a fiftieth of the rows, once to each
    cut, where each group meets each block.
    """
    rows = quantised(vectors, scale)
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    sizes = need(vectors, "vec_id").agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    groups, cuts = max(1, -(-sizes[1] // query_block)), max(CUTS, -(-sizes[0] // CUT))
    blocks = "group int, dim int, ids binary, matrix binary"
    candidates = rows.withColumn("group", F.lit(0)).mapInPandas(_pack(block), blocks).drop("group")
    candidates = candidates.withColumn("cut", F.pmod(F.xxhash64("ids"), F.lit(cuts)).cast("int"))
    asked = rows.where(is_query).distinct().withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    asked = asked.repartition("group").mapInPandas(_pack(2 * query_block), blocks)
    asked = asked.select("dim", F.col("ids").alias("q_ids"), F.col("matrix").alias("queries"))
    asked = asked.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    found = candidates.join(asked, ["cut", "dim"]).select("dim", "ids", "matrix", "q_ids", "queries").mapInPandas(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
