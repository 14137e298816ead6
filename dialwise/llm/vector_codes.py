"""Product codes of vectors by member-resident Lloyd rounds in whole numbers.

A vector is cut into equal parts. Every part is a row that lives with the owner of its codebook entry:
tables are partitioned by (position, entry, salt), the salt spreading an entry that holds a large share
of all parts. A round reads the residents where they lie. A part that is nearest to another entry under
the new codebook moves: only such rows are shuffled, to their new owner, together with the sums of those
that stayed, a few rows per task. The owners' sums over both give the next codebook, which is the only
thing that reaches the driver (positions x entries rows).

No resident is ever rewritten. A row keeps the round in which it arrived; it is still there if every
codebook since then puts it where it is, which a task tells from the codebooks alone. So a round is a
function of files in the shared folder, and a lost executor costs the tasks that ran on it.

Defined cases: a row takes no part if its vector is null, holds a null or non-finite component or one
beyond ``LARGEST`` in magnitude, or has another length than the table: its length is the most common one
that the number of positions divides (the longer of equally common ones). Of rows that repeat an id,
each is coded; first entries are taken by id (null last), then by vector. With fewer rows than entries,
the codebooks are shorter. Nearest entries and new entries are exact; an error beyond a long is returned
as the largest long. Null labels are one label. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialwise.session import broadcast_if_small, frozen

POSITIONS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components beyond this would leave whole numbers of 64 bits once scaled and added up.
LARGEST = float(1 << 28)
#: An owner holds about this many parts of an evenly used codebook; at least ``LEAST_SALTS`` salts.
OWNED, LEAST_SALTS = 1 << 16, 64
#: Rows whose sums surely fit 64 bits, by the bound on components.
_ADDED = 1 << 22

_STATE = (
    "position int, entry int, salt int, born int, members long, row long, vec_id long, label string,"
    " part array<long>"
)
_STATE_FIELDS = [
    ("position", pa.int32()), ("entry", pa.int32()), ("salt", pa.int32()), ("born", pa.int32()),
    ("members", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.string()),
    ("part", pa.list_(pa.int64())),
]
_CODED = "row long, vec_id long, label string, position int, entry int, error decimal(38,0)"
_LONG = (1 << 63) - 1


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """Whole numbers floor(scale * x)."""
    return np.floor(values.astype(np.float64) * scale).astype(np.int64)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per part the nearest entry (the first of equally near ones) and the squared distance, exactly.

    Where every term stays below 2^53, products in double precision are exact; beyond 64 bits, Python's
    whole numbers are used.
    """
    width = parts.shape[1]
    reach = int(np.abs(parts).max(initial=0)) + int(np.abs(entries).max(initial=0))
    if reach * reach * width < 1 << 52:
        x, c = parts.astype(np.float64), entries.astype(np.float64)
        away = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        at = away.argmin(1)
        return at, away[np.arange(len(at)), at].astype(np.int64)
    kind = np.int64 if reach * reach * width < 1 << 62 else object
    x, c = parts.astype(kind), entries.astype(kind)
    away = np.stack([((x - e) ** 2).sum(1) for e in c], 1)
    at = np.array([row.argmin() for row in away], np.int64)
    return at, away[np.arange(len(at)), at]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _state(position, entry, salt, born, members, row, vec_id, label, part) -> pa.RecordBatch:
    """A batch of the state; ``part`` is a matrix, single values stand for every row."""
    n = len(part)
    columns = []
    for value, (_, kind) in zip((position, entry, salt, born, members, row, vec_id, label), _STATE_FIELDS):
        array = value if isinstance(value, pa.Array) else pa.array(np.broadcast_to(value, n))
        columns.append(array.cast(kind))
    ends = pa.array(np.arange(n + 1, dtype=np.int32) * part.shape[1])
    columns.append(pa.ListArray.from_arrays(ends, pa.array(part.ravel(), pa.int64())))
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema(_STATE_FIELDS))


def _first_owners(codebook: np.ndarray, salts: int, scale: int):
    """Rows (row, vec_id, label, vector) to their parts, each at its nearest first entry.

    Id and label travel with the part at position 0.
    """
    positions, _, width = codebook.shape

    def run(batches):
        for batch in batches:
            row, vec_id, label, vector = batch.columns
            whole = scaled(_matrix(vector, positions * width), scale)
            salt = row.to_numpy() % salts
            for k in range(positions):
                part = np.ascontiguousarray(whole[:, k * width : (k + 1) * width])
                at, _ = nearest(part, codebook[k])
                known = (vec_id, label) if k == 0 else (pa.nulls(len(row)), pa.nulls(len(row)))
                yield _state(k, at, salt, 0, 1, row, *known, part)

    return run


class _Residents:
    """The members of a batch of the state that are where they live when codebook ``at`` comes."""

    def __init__(self, batch: pa.RecordBatch, codebooks: list[np.ndarray], at: int):
        batch = batch.filter(pc.greater_equal(batch["row"], 0))
        part = _matrix(batch["part"], codebooks[0].shape[2])
        position, entry = batch["position"].to_numpy(), batch["entry"].to_numpy()
        born = batch["born"].to_numpy()
        here = np.ones(len(part), bool)
        for t in range(1, at):
            asked = here & (born < t)
            here[asked] = self._nearest(codebooks[t], position[asked], part[asked])[0] == entry[asked]
        self.batch, self.part = batch.filter(pa.array(here)), part[here]
        self.position, self.entry = position[here], entry[here]
        self.now, self.error = self._nearest(codebooks[at], self.position, self.part)

    @staticmethod
    def _nearest(codebook, position, part):
        at, error = np.zeros(len(part), np.int64), np.zeros(len(part), object)
        for k in np.unique(position):
            own = position == k
            at[own], error[own] = nearest(part[own], codebook[k])
        return at, error


def _migrate(codebooks: list[np.ndarray], at: int):
    """Those that move to another entry under codebook ``at``, and the sums of those that stay."""

    def run(batches):
        stayed: dict[tuple, tuple] = {}
        added = 0

        def sums():
            keys = sorted(stayed)
            if keys:
                counts = np.array([stayed[k][0] for k in keys])
                place = np.array(keys)
                whole = np.stack([stayed[k][1] for k in keys])
                none = pa.nulls(len(keys))
                yield _state(place[:, 0], place[:, 1], place[:, 2], at, counts, -1, none, none, whole)
            stayed.clear()

        for batch in batches:
            found = _Residents(batch, codebooks, at)
            moves = found.now != found.entry
            gone = found.batch.filter(pa.array(moves))
            yield _state(
                found.position[moves], found.now[moves], gone["salt"], at, 1, gone["row"], gone["vec_id"],
                gone["label"], found.part[moves],
            )
            salt = found.batch["salt"].to_numpy()
            owners = np.stack([found.position, found.entry, salt], 1)[~moves]
            stay = found.part[~moves]
            if added + len(stay) > _ADDED:
                yield from sums()
                added = 0
            added += len(stay)
            if len(stay):
                keys, back = np.unique(owners, axis=0, return_inverse=True)
                order = np.argsort(back.ravel(), kind="stable")
                starts = np.searchsorted(back.ravel()[order], np.arange(len(keys)))
                totals = np.add.reduceat(stay[order], starts)
                counts = np.diff(np.append(starts, len(order)))
                for key, n, total in zip(map(tuple, keys.tolist()), counts.tolist(), totals):
                    before = stayed.get(key, (0, 0))
                    stayed[key] = (before[0] + n, before[1] + total)
        yield from sums()

    return run


def _codes(codebooks: list[np.ndarray]):
    """Every part where it lives at last: its entry under the last codebook and the distance."""
    at = len(codebooks) - 1

    def run(batches):
        for batch in batches:
            found = _Residents(batch, codebooks, at)
            yield pa.RecordBatch.from_arrays(
                [
                    found.batch["row"], found.batch["vec_id"], found.batch["label"],
                    found.batch["position"], pa.array(found.now, pa.int32()),
                    pa.array([int(x) for x in found.error], pa.decimal128(38, 0)),
                ],
                names=["row", "vec_id", "label", "position", "entry", "error"],
            )

    return run


def _updated(codebook: np.ndarray, arrived: DataFrame) -> np.ndarray:
    """The codebook after one round, from the members and sums that the owners got in it."""
    width = codebook.shape[2]
    total = [F.sum(F.col("part")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    owned = arrived.groupBy("position", "entry").agg(F.sum("members").alias("n"), *total)
    new = codebook.copy()
    for r in owned.collect():
        new[r["position"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return new


def _length(rows: DataFrame, positions: int) -> int:
    """The most common vector length that ``positions`` divides; 0 without one."""
    sizes = rows.groupBy(F.size("vector").alias("n")).count().where((F.col("n") > 0) & (F.col("n") % positions == 0))
    found = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    return found["n"] if found else 0


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, positions: int) -> tuple:
    """The rows that take part (row, vec_id, label, vector), kept in the shared folder, and their length."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST))
    rows = vectors.where(F.col(vector_col).isNotNull() & ~bad).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    rows = frozen(rows, "vectors")
    length = _length(rows, positions)
    return rows.where(F.size("vector") == length), length


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positions: int = POSITIONS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """(row, vec_id, label, entries, error) of every usable row, and the codebooks (position, entry,
    place in the part). ``entries`` of a row is an array by position, ``error`` its squared distance.
    """
    rows, length = usable(vectors, id_col, vector_col, label_col, positions)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries)
    seeds = [r["vector"] for r in first.select("vector").collect()]
    width = length // positions
    codebook = np.zeros((positions, len(seeds), width), np.int64)
    if seeds:
        whole = scaled(np.array(seeds), scale).reshape(len(seeds), positions, width)
        codebook = np.ascontiguousarray(whole.transpose(1, 0, 2))
    salts = max(LEAST_SALTS, rows.count() // OWNED)

    def at_owners(state: DataFrame, name: str) -> DataFrame:
        return frozen(state.repartition("position", "entry", "salt"), name)

    codebooks, tables = [codebook], []
    if seeds:
        tables.append(at_owners(rows.mapInArrow(_first_owners(codebook, salts, scale), _STATE), "residents"))
        codebooks.append(_updated(codebook, tables[0]))
        for at in range(1, rounds):
            state = reduce(DataFrame.union, tables)
            tables.append(at_owners(state.mapInArrow(_migrate(codebooks, at), _STATE), "arrivals"))
            codebooks.append(_updated(codebooks[-1], tables[-1]))
        coded = reduce(DataFrame.union, tables).mapInArrow(_codes(codebooks), _CODED)
    else:
        coded = vectors.sparkSession.createDataFrame([], _CODED)
    # The parts of a vector meet again: one row each, so no group is larger than the positions.
    whole = coded.groupBy("row").agg(
        F.max("vec_id").alias("vec_id"),
        F.max("label").alias("label"),
        F.array(*[F.max(F.when(F.col("position") == k, F.col("entry"))) for k in range(positions)]).alias(
            "entries"
        ),
        F.least(F.sum("error"), F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("error"),
    )
    return whole, codebooks[-1]


def codebook_digest(codebook: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebook.ravel().tolist())).encode()).hexdigest()


def code_table(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row.

    The sums per label are joined by broadcast if they are few, else by a shuffle.
    """
    whole, codebook = vector_codes(vectors, **options)
    whole = frozen(whole, "codes")
    places = [F.lpad(F.lower(F.hex(F.col("entries")[k].cast("long"))), 2, "0") for k in range(len(codebook))]
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)"))
    labels = whole.groupBy(F.col("label").alias("of_label")).agg(total.cast("long").alias("label_error"))
    (labels,) = broadcast_if_small(labels)
    return whole.join(labels, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id",
        F.concat(*places).alias("code"),
        "error",
        "label_error",
        F.lit(codebook_digest(codebook)).alias("codebooks_sha256"),
    )
