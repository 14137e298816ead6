"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is normalised, rotated by a random orthogonal matrix (a function of seed and dimension)
and kept as one packed bit per coordinate, with the inner product of the code and the vector as its
correction scalar. The inner product of a query and a vector is estimated from the packed bits: the
query is quantised to ``LEVELS`` bits per coordinate, so that the estimate is a few bit counts. With
an error bound that holds with overwhelming probability (``SURE`` standard deviations) the estimate
gives an upper and a lower bound of the cosine. In each block of vectors those whose upper bound
reaches the k-th largest lower bound are reranked with the original vectors, in double precision.

Queries come in blocks of ``QUERIES`` and vectors in blocks of ``VECTORS``, packed where they are read.
Each block of vectors goes to each block of queries by an equi-join on the number of the query block
(the work is queries times vectors by definition; no block holds more than its bound). At most k rows
per query and block leave a task, and the k best of them are chosen by a window with a group limit.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component takes no
part, nor does one without an id; vectors are only compared with others of their dimension; of equal
scores the smaller id comes first, and rows that repeat an id are candidates of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialwise.session import frozen

K, SEED = 5, 11
QUERIES, VECTORS = 2048, 4096
LEVELS, SURE = 6, 4.0

_BLOCK = "dim int, part int, number int, ids binary, vectors binary, codes binary, corrections binary"
_FOUND = "query_id long, vec_id long, score double"


@cache
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, and the inner product of each with its code."""
    dim = vectors.shape[1]
    turned = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ rotation(dim, seed)
    codes = np.packbits(turned > 0, axis=1)
    return codes, np.abs(turned).sum(axis=1) / np.sqrt(dim)


def _words(codes: np.ndarray) -> np.ndarray:
    """Packed bits as 64-bit words, filled with zeros at the end."""
    wide = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
    wide[:, : codes.shape[1]] = codes
    return wide.view(np.uint64)


def bounds(
    query: np.ndarray, codes: np.ndarray, corrections: np.ndarray, seed: int = SEED
) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the cosines of one query with all coded vectors."""
    dim = len(query)
    turned = query / np.linalg.norm(query) @ rotation(dim, seed)
    low = turned.min()
    step = (turned.max() - low) / (2**LEVELS - 1) or 1.0
    levels = np.rint((turned - low) / step).astype(np.int64)
    words = _words(codes)
    weighted = np.zeros(len(codes))
    for j in range(LEVELS):
        plane = _words(np.packbits(levels >> j & 1).reshape(1, -1))
        weighted += (1 << j) * np.bitwise_count(words & plane).sum(axis=1)
    ones = np.bitwise_count(words).sum(axis=1)
    # Of the code's entries, +-1/sqrt(dim): the sum over ones less the sum over zeros.
    inner = (2 * (step * weighted + low * ones) - step * levels.sum() - low * dim) / np.sqrt(dim)
    estimate = inner / corrections
    # Rounding the query errs by at most half a step per entry; the code by chance.
    spread = np.sqrt((1 - corrections**2).clip(0) / max(dim - 1, 1)) / corrections
    error = SURE * (spread + step / 2 / corrections * 0.6)
    return estimate - error, estimate + error


def cosine(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision; sums run in the order of the components, wherever computed."""

    def total(x: np.ndarray) -> np.ndarray:
        return np.add.accumulate(x, axis=-1)[..., -1]

    return total(vectors * query) / (np.sqrt(total(vectors**2)) * np.sqrt(total(query**2)))


def nearest(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray,
    codes: np.ndarray, corrections: np.ndarray, k: int = K,
) -> tuple[list, list, list]:
    """The k best of a block for each query, scored exactly: query ids, ids, scores."""
    out: tuple[list, list, list] = ([], [], [])
    for query, query_id in zip(queries, query_ids):
        lower, upper = bounds(query, codes, corrections)
        other = ids != query_id
        lower = lower[other]
        if not len(lower):
            continue
        least = np.partition(lower, -k)[-k] if len(lower) > k else -np.inf
        near = np.flatnonzero(other & (upper >= least))
        score = cosine(vectors[near], query)
        best = np.lexsort((ids[near], -score))[:k]
        out[0].extend([query_id] * len(best))
        out[1].extend(ids[near[best]].tolist())
        out[2].extend(score[best].tolist())
    return out


def _pack(size: int):
    def run(batches):
        held: dict[int, list] = {}
        number = 0

        def block(dim: int, rows: list):
            nonlocal number
            vectors = np.array([v for _, v in rows], np.float64)
            codes, corrections = encode(vectors)
            number += 1
            return {
                "dim": dim, "part": 0, "number": number,
                "ids": np.array([i for i, _ in rows], np.int64).tobytes(),
                "vectors": vectors.tobytes(), "codes": codes.tobytes(),
                "corrections": corrections.tobytes(),
            }

        for batch in batches:
            full = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = held.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) == size:
                    full.append(block(len(v), held.pop(len(v))))
            if full:
                yield pa.RecordBatch.from_pylist(full, schema=_SCHEMA)
        rest = [block(dim, rows) for dim, rows in held.items()]
        if rest:
            yield pa.RecordBatch.from_pylist(rest, schema=_SCHEMA)

    return run


_SCHEMA = pa.schema(
    [("dim", pa.int32()), ("part", pa.int32()), ("number", pa.int32())]
    + [(n, pa.binary()) for n in ("ids", "vectors", "codes", "corrections")]
)


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Packed blocks of at most ``size`` vectors of one dimension, numbered within their partition."""
    packed = vectors.mapInArrow(_pack(size), _BLOCK)
    return packed.withColumn("part", F.spark_partition_id())


def _search(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                found = nearest(
                    np.frombuffer(row["queries"]).reshape(-1, dim),
                    np.frombuffer(row["query_ids"], np.int64),
                    np.frombuffer(row["vectors"]).reshape(-1, dim),
                    np.frombuffer(row["ids"], np.int64),
                    np.frombuffer(row["codes"], np.uint8).reshape(-1, -(-dim // 8)),
                    np.frombuffer(row["corrections"]),
                    k,
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def usable(vector: str | Column, id_col: str) -> Column:
    column = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(id_col).isNotNull() & column.isNotNull() & finite & F.exists(column, lambda x: x != 0)


def search(
    table: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row for which ``is_query`` holds."""
    rows = table.where(usable(vector, id_col)).select(
        F.col(id_col).alias("vec_id"),
        F.transform(vector, lambda x: x.cast("double")).alias("vector"),
        is_query.alias("is_query"),
    )
    asked = frozen(blocks(rows.where("is_query").select("vec_id", "vector"), QUERIES), "queries")
    asked = asked.select(
        "dim", "part", "number", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries")
    )
    names = asked.groupBy("dim").agg(F.collect_list(F.struct("part", "number")).alias("asked"))
    coded = blocks(rows.select("vec_id", "vector"), VECTORS).drop("part", "number")
    pairs = (
        coded.join(names, "dim")
        .withColumn("asked", F.explode("asked"))
        .select("*", "asked.part", "asked.number")
        .drop("asked")
        .join(asked, ["dim", "part", "number"])
    )
    found = pairs.mapInArrow(_search(k), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
