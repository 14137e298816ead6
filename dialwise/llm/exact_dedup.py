"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary finds the digests that may be frequent. Their sizes and first rows are then
counted exactly and broadcast (at most ``counters`` rows), so the rows of a huge group of copies are
settled where they are read. Only the other digests, of which none is frequent, are shuffled.

Defined cases: a null text counts as empty; a null id is larger than any other; of rows that repeat
an id and a text one row stays; an empty table gives an empty result; other columns are ignored by
:func:`label_copies` and kept by :func:`drop_copies`.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialwise.llm.common import SPACE, filled, fresh
from dialwise.session import frozen

COUNTERS = 256


def digest(text: str | Column) -> Column:
    """SHA-256 of the text with each run of white space replaced by one space."""
    return F.unhex(F.sha2(F.regexp_replace(filled(text), SPACE, " "), 256))


def _summaries(counters: int):
    """Misra-Gries over one partition: at most ``counters`` digests with lower bounds of their counts."""

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            keys, counts = found.field(0).to_pylist(), found.field(1).to_pylist()
            held.update(dict(zip(keys, counts)))
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = Counter({k: n - cut for k, n in held.items() if n > cut})
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
            names=["digest", "at_least"],
        )

    return run


def heavy_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests, the most frequent by their summed lower bounds."""
    return (
        digests.select("digest")
        .mapInArrow(_summaries(counters), "digest binary, at_least long")
        .groupBy("digest")
        .agg(F.sum("at_least").alias("at_least"))
        .orderBy(F.desc("at_least"), "digest")
        .limit(counters)
        .select("digest")
    )


def _groups(digests: DataFrame) -> DataFrame:
    """Per digest its size, and the id and row that stay."""
    return digests.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min("doc_id").alias("keep_id"),
        F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep_row"),
    )


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, digest and a number of every row, computed once."""
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest"))
    return frozen(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


def winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The verified groups of the heavy digests: at most ``counters`` rows."""
    heavy = F.broadcast(heavy_digests(digests, counters))
    return frozen(_groups(digests.join(heavy, "digest", "left_semi")), "winners")


def label_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = digest_table(docs, id_col, text_col)
    won = F.broadcast(winners(digests, counters))
    light = digests.join(won, "digest", "left_anti")
    settled = digests.join(won, "digest").unionByName(light.join(_groups(light), "digest"))
    return settled.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all of its columns kept."""
    key, won_key, won_id, place = fresh(docs, "digest", "won_digest", "won_id", "place")
    won = winners(digest_table(docs, id_col, text_col), counters).select(
        F.col("digest").alias(won_key), F.col("keep_id").alias(won_id)
    )
    left = (
        docs.withColumn(key, digest(text_col))
        .join(F.broadcast(won), F.col(key) == F.col(won_key), "left")
        .where(F.col(won_key).isNull() | F.col(id_col).eqNullSafe(F.col(won_id)))
    )
    order = Window.partitionBy(key).orderBy(F.col(id_col).asc_nulls_last(), text_col)
    first = left.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return first.select(*[F.col(f"`{c}`") for c in docs.columns])
