"""Vector best-fit packing of tokenised documents.

Every document becomes its token ids and an end id; one longer than a sequence is cut into full pieces
after a first, shorter one. A bin is one training sequence with three capacities: tokens, documents,
and attention cost (the sum of squared piece lengths, as attention does not cross documents). Pieces
are placed longest first, each in the open bin that fits it under every capacity and that leaves the
smallest weighted norm of residual capacities (or has the largest weighted dot product with it).

Pieces, not texts, are dealt by a hash of their row into shards of about ``SHARD`` pieces, whatever
their document; a task packs one shard, so a shard leaves about one bin unfilled among thousands.
Full pieces are sequences of their own and are not dealt at all.

Defined cases: a null or empty text is its end id alone; a text may be of any length and hold runs of
white space of any length; a null id is kept as it is; repeated rows are
packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from functools import cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dialwise.llm.common import filled
from dialwise.session import frozen

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENS, END = 2048, 0
#: Further capacities of a sequence: by default the largest that its tokens allow.
DOCUMENTS, COST = TOKENS, TOKENS**2
WEIGHTS = (1.0, 0.01, 0.01)
SHARD = 16384

_TWO_SPACES = re.compile(r"\s\s")
#: The look-ahead of the rule for runs of white space fails on runs near a million characters; texts with
#: runs beyond this go to the ``tokenizers`` library, which gives the same ids more slowly.
LONG_RUN = 50_000
_LONG_RUN = re.compile(rf"\s{{{LONG_RUN}}}")
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@cache
def _encoders(path: str) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    """The encoding of a rank file, and the same without the rule for runs of white space.

    Without look-ahead the splitting is much faster, and equal where no run has two characters.
    """
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = public_tokenizers.PATTERN
    plain = pattern.replace(r"|\s+(?!\S)", "")
    return tuple(
        tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={})
        for name, p in (("whole", pattern), ("plain", plain))
    )


@cache
def _library(path: str) -> Tokenizer:
    """The ``tokenizers`` model that lies beside a rank file, under the same name."""
    tokenizer = Tokenizer.from_file(str(Path(path).with_suffix(".json")))
    tokenizer.encode_special_tokens = True
    return tokenizer


def token_ids(text: str, path: str = VOCABULARY) -> list[int]:
    """The ids of a text; strings of special tokens in it are ordinary text."""
    if not _TWO_SPACES.search(text):
        return _encoders(path)[1].encode_ordinary(text)
    if _LONG_RUN.search(text):
        return _library(path).encode(text, add_special_tokens=False).ids
    return _encoders(path)[0].encode_ordinary(text)


def cut(length: int, most: int = TOKENS) -> list[tuple[int, int]]:
    """start and length of the pieces of a document; only the first may be shorter than ``most``."""
    first = length if length <= most else length % most or most
    return [(0, first), *((at, most) for at in range(first, length, most))]


def _tokenise(path: str, most: int):
    def run(batches):
        for batch in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = array("I", token_ids(text, path))
                ids.append(END)
                view = memoryview(ids)
                for piece, (start, length) in enumerate(cut(len(ids), most)):
                    crc = zlib.crc32(view[start : start + length])
                    for column, value in zip(rows, (doc_id, piece, start, length, crc)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str = VOCABULARY,
    most: int = TOKENS,
) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    texts = docs.select(F.col(id_col).alias("doc_id"), filled(text_col).alias("text"))
    return texts.mapInArrow(_tokenise(path, most), _PIECES)


def best_fit(
    lengths: np.ndarray,
    capacity: tuple[int, int, int] = (TOKENS, DOCUMENTS, COST),
    weights: tuple[float, float, float] = WEIGHTS,
    by: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, longest first.

    ``by``: "norm" takes the bin whose residual, less the piece, has the smallest weighted norm;
    "dot" the one whose residual has the largest weighted dot product with the piece. Of equal bins
    the first is taken. A piece that exceeds a capacity alone gets a bin of its own.
    """
    n = len(lengths)
    size = np.stack([lengths, np.ones(n, np.int64), lengths.astype(np.int64) ** 2])
    whole, weight = np.array(capacity, np.int64)[:, None], np.array(weights)[:, None]
    place, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left, number = np.zeros((3, n), np.int64), np.zeros(n, np.int64)
    open_, made = 0, 0
    order = np.argsort(-lengths, kind="stable")
    least = size[:, order[-1]] if n else None
    for i in order:
        item = size[:, i : i + 1]
        room = left[:, :open_] - item
        fits = np.flatnonzero((room >= 0).all(axis=0))
        if len(fits):
            if by == "norm":
                worth = -(weight * (room[:, fits] / whole) ** 2).sum(axis=0)
            else:
                worth = (weight * (left[:, fits] / whole) * (item / whole)).sum(axis=0)
            at = fits[worth.argmax()]
        else:
            at, open_ = open_, open_ + 1
            left[:, at], number[at] = whole[:, 0], made
            made += 1
        place[i], offset[i] = number[at], capacity[0] - left[0, at]
        left[:, at] -= item[:, 0]
        if (left[:, at] < least).any():
            # No piece fits there any more: the last open bin takes its place.
            open_ -= 1
            left[:, at], number[at] = left[:, open_], number[open_]
    return place, offset


def _pack(capacity, weights, by):
    def run(group: pa.Table) -> pa.Table:
        bins, offset = best_fit(group["length"].to_numpy(), capacity, weights, by)
        shard = group["shard"].to_numpy().astype(np.int64)
        packed = group.drop_columns(["shard", "row"])
        packed = packed.append_column("sequence_id", pa.array((shard << 32) + bins))
        return packed.append_column("offset", pa.array(offset))

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str = VOCABULARY,
    capacity: tuple[int, int, int] = (TOKENS, DOCUMENTS, COST),
    weights: tuple[float, float, float] = WEIGHTS,
    by: str = "norm",
) -> DataFrame:
    """The pieces of :func:`pieces` with the sequence_id and the offset that each is placed at."""
    cut_up = frozen(pieces(docs, id_col, text_col, path, capacity[0]), "pieces")
    full = F.col("length") == capacity[0]
    numbered = cut_up.withColumn("row", F.monotonically_increasing_id())
    alone = numbered.where(full).select(
        *cut_up.columns,
        (-1 - F.col("row")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    shards = cut_up.where(~full).count() // SHARD + 1
    packed = (
        numbered.where(~full)
        .withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(_pack(capacity, weights, by), f"{_PIECES}, sequence_id long, offset long")
    )
    return packed.unionByName(alone)
