"""SimHash near-dedup by anchor points of a covering code.

The code: two binary Golay codewords of 23 bits, over bits 0-22 and 23-45 of the fingerprint. Each
half covers its bits with radius 3 and is perfect, so every fingerprint has one home anchor. If x and
y differ in at most two bits, y is within 3 + e1 and 3 + e2 bits of the halves of x's home, with
e1 + e2 <= 2. A fingerprint therefore goes to every anchor within covering radius plus threshold,
counted over the halves: about 61 of 16.8 million anchors, whatever the number of documents. Both
fingerprints of a link meet at least at one home. Equal fingerprints are one class before that.

At an anchor all pairs are compared, and a spanning forest of the links is written, never the links
themselves. An anchor with more than ``LIMIT`` fingerprints passes them on unchanged: their links are
found, exactly and in rows that spread over all tasks, by the words one bit away (two fingerprints
differ in at most two bits if and only if they share such a word or are one another's).

Defined cases: a null or empty text has fingerprint zero and links like any other; a null id is
larger than any other; repeated rows share a component; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from dialwise.llm.common import filled, fresh
from dialwise.llm.components import components
from dialwise.session import frozen

WORDS, SEED, BITS = 3, 42, 2
#: Fixed value: the generator polynomial of the binary Golay code.
GOLAY, LENGTH, RADIUS = 0xC75, 23, 3
#: Fingerprints of one anchor that a task holds and compares.
LIMIT = 4096


def fingerprint(text: bytes, size: int = WORDS) -> int:
    """The 64-bit SimHash of the text's shingles of ``size`` words, unsigned."""
    words = text.lower().split()
    n = len(words) - size + 1
    joined = b" ".join(words)
    if not words:
        return 0
    if n < 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[: n - 1]]
    hashes = [
        xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :])
    ]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(n, 8), axis=1)
    most = 2 * np.add.reduce(bits, axis=0, dtype=np.int64) > n
    return int(np.packbits(most).view("<u8")[0])


def fingerprint_of(text: Column, size: int = WORDS) -> Column:
    """The fingerprints of a column of texts without nulls, as signed 64-bit numbers."""

    def run(text: pa.Array) -> pa.Array:
        found = (fingerprint(t.encode(), size) for t in text.to_pylist())
        return pa.array(np.fromiter(found, np.uint64, len(text)).view(np.int64))

    return F.arrow_udf(run, LongType())(text)


def _syndrome(words: np.ndarray, high: np.ndarray) -> np.ndarray:
    return high[words >> 11] ^ (words & 2047)


@cache
def _patterns():
    """By syndrome: the one error of weight <= 3, and the errors of weight 4 and of weight 5."""
    high = np.zeros(1 << (LENGTH - 11), np.int64)
    for i in range(LENGTH - 11):
        rest = 1 << (i + 11)
        for bit in range(i + 11, 10, -1):
            if rest >> bit & 1:
                rest ^= GOLAY << (bit - 11)
        high[1 << i : 2 << i] = high[: 1 << i] ^ rest
    levels = []
    for weights in (range(RADIUS + 1), [RADIUS + 1], [RADIUS + 2]):
        errors = np.array(
            [sum(1 << b for b in c) for w in weights for c in combinations(range(LENGTH), w)]
        )
        kind = _syndrome(errors, high)
        order = np.argsort(kind, kind="stable")
        count = np.bincount(kind, minlength=2048)
        levels.append((errors[order], np.cumsum(count) - count, count))
    return high, levels


def _within(word: np.ndarray, level: int, high: np.ndarray, levels) -> tuple[np.ndarray, np.ndarray]:
    """Rows and codewords at distance ``RADIUS + level`` (0: up to RADIUS) of each row's word."""
    errors, start, count = levels[level]
    kind = _syndrome(word, high)
    n = count[kind]
    row = np.repeat(np.arange(len(word)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row, word[row] ^ errors[start[kind[row]] + at]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and anchors: every anchor within covering radius plus threshold of each fingerprint."""
    high, levels = _patterns()
    mask = (1 << LENGTH) - 1
    first, second = fp & mask, fp >> LENGTH & mask
    rows, found = [], []
    for e1 in range(BITS + 1):
        row1, code1 = _within(first, e1, high, levels)
        for e2 in range(BITS + 1 - e1):
            row2, code2 = _within(second[row1], e2, high, levels)
            rows.append(row1[row2])
            found.append(code1[row2] | code2 << LENGTH)
    return np.concatenate(rows), np.concatenate(found)


def _replicate(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for part in np.array_split(fp, len(fp) // 2000 + 1):
            row, anchor = anchors(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(part[row])], names=["anchor", "fp"]
            )


def join_up(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of the sets of i and j in the forest ``root``, in place; roots are the smallest members."""
    while True:
        while (root[root] != root).any():
            root[:] = root[root]
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))


def _forest(anchor: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside each run of equal anchors."""
    root, at, step = np.arange(len(fp)), np.arange(len(fp)), 1
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle():
        if held:
            join_up(root, *(np.concatenate(x) for x in zip(*held)))
            held.clear()

    while True:
        at = at[: np.searchsorted(at, len(fp) - step)]
        at = at[anchor[at] == anchor[at + step]]
        if not len(at):
            break
        apart = (fp[at] ^ fp[at + step]).view(np.uint64)  # bits of signed numbers lack the sign
        near = at[np.bitwise_count(apart) <= BITS]
        if len(near):
            held.append((near, near + step))
        if sum(len(x) for x, _ in held) > 1_000_000:
            settle()
        step += 1
    settle()
    low = root != np.arange(len(fp))
    return fp[low], fp[root[low]]


def _compare(batches):
    """Rows sorted by anchor in, links (a, b) out; (a, null) for a member of a crowded anchor."""

    def found(a, b):
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), b if isinstance(b, pa.Array) else pa.array(b, pa.int64())],
            names=["a", "b"],
        )

    anchor, fp, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        anchor = np.concatenate([anchor, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(anchor):
            continue
        over = np.searchsorted(anchor, crowded, "right") if crowded is not None else 0
        if over:
            yield found(fp[:over], pa.nulls(over, pa.int64()))
            anchor, fp = anchor[over:], fp[over:]
        last = np.searchsorted(anchor, anchor[-1]) if len(anchor) else 0
        if last:
            yield found(*_forest(anchor[:last], fp[:last]))
            anchor, fp = anchor[last:], fp[last:]
        if len(anchor) > LIMIT:
            crowded = anchor[0]
            yield found(fp, pa.nulls(len(fp), pa.int64()))
            anchor, fp = anchor[:0], fp[:0]
    if len(anchor):
        yield found(*_forest(anchor, fp))


def _by_middle_words(fps: DataFrame) -> DataFrame:
    """Links of the given fingerprints: each joins the smallest at every word within one bit of it."""
    masks = [0, *(1 << i for i in range(63)), -(1 << 63)]
    flips = F.array(*[F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in masks])
    words = fps.select("fp", F.explode(flips).alias("word"))
    # A word is within one bit of at most 65 fingerprints.
    least = F.min("fp").over(Window.partitionBy("word"))
    return words.select(F.col("fp").alias("a"), least.alias("b")).where("a != b").distinct()


def links(fps: DataFrame) -> DataFrame:
    """(a, b): pairs of different fingerprints whose components are those of all links."""
    spread = (
        fps.select("fp")
        .mapInArrow(_replicate, "anchor long, fp long")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
    )
    compared = frozen(spread.mapInArrow(_compare, "a long, b long").distinct(), "links")
    crowded = compared.where("b IS NULL").select(F.col("a").alias("fp"))
    return compared.where("b IS NOT NULL").unionByName(_by_middle_words(crowded))


def component_of_fingerprints(prints: DataFrame) -> DataFrame:
    """fp, root and component_id (smallest doc_id of the component) from rows of doc_id and fp."""
    classes = frozen(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes)).select(F.col("node").alias("fp"), "root")
    placed = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return frozen(placed.select("fp", "root").join(whole, "root"), "groups")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits, of shingles of ``words`` words) and component_id of every row
    of ``docs``."""
    prints = docs.select(
        F.col(id_col).alias("doc_id"), fingerprint_of(filled(text_col), words).alias("fp")
    )
    prints = frozen(prints, "fingerprints")
    return prints.join(component_of_fingerprints(prints), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS
) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, of equal ids the smallest
    fingerprint, then text. All columns are kept."""
    key, place = fresh(docs, "fp", "place")
    marked = docs.withColumn(key, fingerprint_of(filled(text_col), words))
    prints = frozen(
        marked.select(F.col(id_col).alias("doc_id"), F.col(key).alias("fp")), "fingerprints"
    )
    kept_id, kept_fp = fresh(marked, "kept_id", "kept_fp")
    chosen = (
        prints.join(component_of_fingerprints(prints), "fp")
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root", "component_id")
        .agg(F.min("fp").alias(kept_fp))
        .select(F.col("component_id").alias(kept_id), kept_fp)
    )
    stays = marked.join(
        chosen,
        F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_fp)),
        "left_semi",
    )
    order = Window.partitionBy(id_col, key).orderBy(text_col)
    first = stays.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return first.select(*[F.col(f"`{c}`") for c in docs.columns])
