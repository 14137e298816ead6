"""Find, read and write the Parquet tables. Any file system Spark can reach will do."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialwise.schemas import DISPATCH, EVENTS, PHONE_DIM, check_contract
from dialwise.session import file_system

# Names of the two input tables.
DISPATCH_TABLE = "base_disparo_mascarado"
PHONE_TABLE = "dim_telefone_mascarado"

# What may follow the name of a table in the name of a shard: -000, -new, _part1, _7, .3.
_SHARD = re.compile(r"(-[^-/]*|[_.](part)?-?\d+)?(\.\w+)*$")

_SPARK_FILE = re.compile(r"part-\d{4,}")

# What a table's files or folders may end in without being one.
_OTHER = (".yml", ".json", ".md", ".csv", ".txt")


class TableNotFound(FileNotFoundError):
    """No file below the folder belongs to the table."""


class AmbiguousTable(ValueError):
    """Files of several tables match the name."""


def _table_of(part: str) -> str:
    """The name of a file or folder without shard suffix and endings."""
    return _SHARD.sub("", part, count=1)


def _entries(spark: SparkSession, folder: str):
    """(name, path, is a folder) of what lies directly in ``folder``, one after the other."""
    system, hadoop = file_system(spark, folder)
    listed = system.listStatusIterator(hadoop)
    while listed.hasNext():
        status = listed.next()
        name = status.getPath().getName()
        if not name.startswith(("_", ".")):
            yield name, status.getPath().toString(), status.isDirectory()


def _holds_files(spark: SparkSession, folder: str) -> bool:
    return any(not inner or _holds_files(spark, path) for _, path, inner in _entries(spark, folder))


def _matches(spark: SparkSession, root: str, name: str) -> tuple[list, dict[str, list]]:
    """(path, is a folder) of what bears the table's name, and of what contains it, by its own name.

    A folder that bears the name is not entered: what lies in it, however many files, is the table.
    """
    exact: list = []
    near: dict[str, list] = {}
    waiting = [(root, False)]
    while waiting:
        folder, inside_near = waiting.pop()
        for own, path, inner in _entries(spark, folder):
            part = _table_of(own)
            # In a folder, Spark's own file names say nothing about the table.
            if not inner and (own.endswith(_OTHER) or folder != root and _SPARK_FILE.match(own)):
                continue
            if part == name:
                if not inner or _holds_files(spark, path):
                    exact.append((path, inner))
                continue
            found = not inside_near and name in part
            if found and (not inner or _holds_files(spark, path)):
                near.setdefault(part, []).append((path, inner))
            if inner:
                waiting.append((path, inside_near or found))
    return exact, near


def find_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root``, with all of its shards, however deep they lie.

    A file or folder belongs to it if its name is the table's, apart from a shard suffix and endings. If
    none does, names that contain ``name`` count, provided that they all belong to one table; else the
    error lists what matched. Only folders on the way are listed, one at a time. A folder of the table is
    read as a whole: folders in it such as ``day=2024-01-01`` are columns, and filters on them skip the
    others.
    """
    root = root.rstrip("/")
    exact, near = _matches(spark, root, name)
    if not exact and len(near) > 1:
        raise AmbiguousTable(f"{name} below {root} may be any of {sorted(near)}")
    found = exact or [place for places in near.values() for place in places]
    if not found:
        raise TableNotFound(f"no Parquet file for table {name} below {root}")
    files = [path for path, inner in found if not inner]
    tables = [spark.read.parquet(*files)] if files else []
    # Each folder is the base of its own partition columns.
    tables += [spark.read.option("basePath", path).parquet(path) for path, inner in found if inner]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_dispatch(spark: SparkSession, root: str, name: str = DISPATCH_TABLE) -> DataFrame:
    """The dispatch log: one row per message sent."""
    return check_contract(find_table(spark, root, name), DISPATCH, name)


def read_phone_dim(spark: SparkSession, root: str, name: str = PHONE_TABLE) -> DataFrame:
    """The phone dimension: one row per phone with the list of its appearances."""
    return check_contract(find_table(spark, root, name), PHONE_DIM, name)


def write_events(events: DataFrame, path: str, by_day: bool = False) -> str:
    """Write the attributed events; ``by_day`` makes one folder per send date.

    By day, the rebalance hint gathers each date, and lets AQE choose the number of its files and
    split a date that is too large for one of them. Otherwise the partitions of the attribution
    are written as they are, without another shuffle.
    """
    out = events.select(*EVENTS.fieldNames())
    if by_day:
        out = out.hint("rebalance", "envio_data")
        out.write.mode("overwrite").partitionBy("envio_data").parquet(path)
    else:
        out.write.mode("overwrite").parquet(path)
    return path


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The attributed events written by :func:`write_events`."""
    events = check_contract(spark.read.parquet(path), EVENTS, path)
    return events.select(*EVENTS.fieldNames())


#: Bytes of a row group of the candidates: what a lookup reads at least.
ROW_GROUP = 1 << 20


def write_candidates(candidates: DataFrame, path: str, row_group: int = ROW_GROUP) -> str:
    """Write the candidates so that the rows of one person lie together and are found without a scan.

    Rows are sorted by person over all files, so the smallest and largest person of a file and of each
    row group tell a reader to skip it; a Bloom filter of the persons does where that range is wide. A
    person with many rows fills neighbouring row groups and files.
    """
    (
        candidates.repartitionByRange("cpf", "telefone")
        .sortWithinPartitions("cpf", "telefone")
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#cpf", "true")
        .option("parquet.block.size", str(row_group))
        .parquet(path)
    )
    return path


def lookup_candidates(spark: SparkSession, path: str, people: Sequence[int]) -> DataFrame:
    """The candidates of the given people, from the row groups that may hold them."""
    return spark.read.parquet(path).where(F.col("cpf").isin(*people))
