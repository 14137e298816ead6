"""An event store that grows by day and rewrites only the periods that an update touches.

A store is a folder:

* ``events``, ``profiles`` and ``people``: the attributed events, their daily profile and the sketches of
  their people, one folder per period of send days: a day, or a month where days are small;
* ``versions/<n>``: what update ``n`` saw. ``periods`` has a fingerprint of the dispatches of each
  period, ``phones`` the history of each phone. An update counts once its version is marked complete.

An update compares the dispatch log and the dimension with the last version. Touched are the periods
whose dispatches differ, those of dispatches for which the history of their phone gives another answer
than before (a late update of the dimension touches only days after it, or days that had nothing valid),
and those of rows that share an id with rows or former events of these. These periods are attributed
again and replaced by a dynamic partition overwrite; the others are neither read nor written. Running an
update again, also after one that broke off, gives the same store. The driver sees periods only, never
rows: a list bounded by the calendar.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialwise.operators.attribution import (
    events_of_histories,
    phone_histories,
    state_on,
    with_send_day,
)
from dialwise.operators.profiles import daily_profile, people_sketches
from dialwise.schemas import DISPATCH, EVENTS, PHONE_ATTRIBUTES
from dialwise.session import file_system, frozen

#: The column that periods are kept by, and their lengths as SQL.
PERIOD = "periodo"
UNITS = {"day": "envio_data", "month": "trunc(envio_data, 'MM')"}


@dataclass(frozen=True)
class Update:
    """What an update did: its version, the first days of the periods it replaced (None: without a send
    day), and why."""

    version: int
    periods: tuple[dt.date | None, ...]
    new_dispatches: int
    changed_phones: int


def _fingerprint(columns: list[str]) -> list[Column]:
    """The number of rows, and two sums over their hashes that don't depend on the order of rows."""
    row = F.xxhash64(*columns)
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(row.cast("decimal(38,0)")).alias("added"),
        F.bit_xor(F.xxhash64(row, F.lit("x"))).alias("mixed"),
    ]


def _prints(sent: DataFrame) -> DataFrame:
    return sent.groupBy(PERIOD).agg(*_fingerprint(DISPATCH.fieldNames()))


def _changed_periods(new: DataFrame, old: DataFrame) -> DataFrame:
    """Periods that are new, gone, or have other dispatches."""
    prints = ["n", "added", "mixed"]
    both = new.withColumn("of", F.lit("new")).unionByName(old.withColumn("of", F.lit("old")))
    return (
        both.groupBy(PERIOD, *prints)
        .agg(F.count(F.lit(1)).alias("seen"))
        .where("seen = 1")
        .select(PERIOD)
        .distinct()
    )


def _changed_phones(new: DataFrame, old: DataFrame) -> DataFrame:
    """(contato_telefone, before, now): the histories of phones that are new, gone or changed."""
    columns = [c for c in new.columns if c != "phone"]

    def packed(histories: DataFrame, name: str) -> DataFrame:
        return histories.select(F.col("phone").alias("contato_telefone"), F.struct(*columns).alias(name))

    both = packed(old, "before").join(packed(new, "now"), "contato_telefone", "full")
    return both.where(~F.col("before").eqNullSafe(F.col("now")))


def _answer(side: str) -> str:
    """What an event takes from the history of its phone."""
    state = state_on("envio_data", f"{side}.")
    attributes = ", ".join(f"{side}.{a} AS {a}" for a in PHONE_ATTRIBUTES)
    return f"""struct({state}.valid IS NOT NULL AS prefer, coalesce({state}.valid, {side}.any) AS won,
                      {attributes})"""


def _answered_anew(sent: DataFrame, changed: DataFrame) -> DataFrame:
    asked = sent.join(changed, "contato_telefone")
    return asked.where(F.expr(f"NOT ({_answer('before')} <=> {_answer('now')})")).select(PERIOD).distinct()


def _periods(table: DataFrame) -> set:
    """The periods of a table that has one row per period: bounded by the calendar."""
    return {r[PERIOD] for r in table.select(PERIOD).collect()}


def _in(periods: set) -> Column:
    named = F.col(PERIOD).isin([d for d in periods if d is not None])
    return F.col(PERIOD).isNull() | named if None in periods else F.coalesce(named, F.lit(False))


class EventStore:
    """The store in a folder that all executors share, by ``unit`` (a store keeps its unit)."""

    def __init__(
        self, spark: SparkSession, path: str, null_dates: str = "first", unique_ids: bool = False,
        unit: str = "day",
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.null_dates, self.unique_ids, self.period = null_dates, unique_ids, F.expr(UNITS[unit])

    def read(self, name: str = "events") -> DataFrame:
        """``events``, ``profiles`` or ``people`` as the last update left them."""
        if self.version() < 0:
            raise FileNotFoundError(f"no complete update below {self.path}")
        return self._read(name).drop(PERIOD)

    def _read(self, name: str) -> DataFrame:
        events = self.spark.createDataFrame([], EVENTS)
        like = {"events": lambda e: e, "profiles": daily_profile, "people": people_sketches}[name](events)
        whole = like.withColumn(PERIOD, F.lit(None).cast("date"))
        return self.spark.read.schema(whole.schema).parquet(f"{self.path}/{name}")

    def version(self) -> int:
        """The last complete version, -1 before the first."""
        system, folder = file_system(self.spark, f"{self.path}/versions")
        if not system.exists(folder):
            return -1
        found = [entry.getPath() for entry in system.listStatus(folder)]
        done = [int(p.getName()) for p in found if system.exists(file_system(self.spark, f"{p}/_COMPLETE")[1])]
        return max(done, default=-1)

    def _seen(self, version: int, name: str, like: DataFrame) -> DataFrame:
        if version < 0:
            return like.limit(0)
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/versions/{version}/{name}")

    def _replace(self, name: str, table: DataFrame, periods: set, kept: set) -> None:
        path, table = f"{self.path}/{name}", table.withColumn(PERIOD, self.period)
        out = table.hint("rebalance", PERIOD).write.mode("overwrite").partitionBy(PERIOD)
        out.option("partitionOverwriteMode", "dynamic").parquet(path)
        # A period that lost its last row has no new folder to replace the old one.
        for period in periods - kept:
            folder = "__HIVE_DEFAULT_PARTITION__" if period is None else period.isoformat()
            system, gone = file_system(self.spark, f"{path}/{PERIOD}={folder}")
            system.delete(gone, True)

    def update(self, dispatch: DataFrame, appearances: DataFrame) -> Update:
        """Bring the store to the given log and dimension (whole tables), and say what was replaced."""
        last = self.version()
        new_version = f"{self.path}/versions/{last + 1}"
        sent = with_send_day(dispatch).withColumn(PERIOD, self.period)
        histories = phone_histories(appearances, self.null_dates, PHONE_ATTRIBUTES)
        seen = (("periods", _prints(sent)), ("phones", histories))
        for name, table in seen:
            table.write.mode("overwrite").parquet(f"{new_version}/{name}")
        now = {name: self._seen(last + 1, name, table) for name, table in seen}
        old = {name: self._seen(last, name, table) for name, table in seen}
        # The first load answers every dispatch for the first time, so its phones need no comparison.
        changed = now["phones"]
        if last >= 0:
            changed = frozen(_changed_phones(now["phones"], old["phones"]), "changed-phones")
        periods = _periods(_changed_periods(now["periods"], old["periods"]))
        new = now["periods"].where(_in(periods)).agg(F.sum("n")).first()[0] or 0
        if last >= 0:
            periods |= _periods(_answered_anew(sent.where(~_in(periods)), changed))
        rows, periods = self._closed(sent, periods)
        events = events_of_histories(rows, now["phones"], self.null_dates, unique_ids=self.unique_ids)
        here = events.withColumn(PERIOD, self.period).where(_in(periods))
        events = frozen(here.select(*EVENTS.fieldNames()), "new-events")
        here = events.groupBy(self.period.alias(PERIOD)).agg(F.count("cpf").alias("people")).collect()
        kept = {r[PERIOD] for r in here}
        self._replace("events", events, periods, kept)
        self._replace("profiles", daily_profile(events), periods, kept)
        self._replace("people", people_sketches(events), periods, {r[PERIOD] for r in here if r["people"]})
        system, mark = file_system(self.spark, f"{new_version}/_COMPLETE")
        system.create(mark).close()
        in_order = tuple(sorted(periods, key=lambda d: (d is not None, d or dt.date.min)))
        return Update(last + 1, in_order, int(new), changed.count())

    def _closed(self, sent: DataFrame, periods: set) -> tuple[DataFrame, set]:
        """The dispatches that decide the events of ``periods``, and these periods with those of rows that
        share an id with them."""
        names = DISPATCH.fieldNames()
        if self.unique_ids:
            return sent.where(_in(periods)).select(*names), periods
        spans = sent.groupBy("id_disparo").agg(
            F.min(PERIOD).alias("a"), F.max(PERIOD).alias("b"),
            F.count(PERIOD).alias("dated"), F.count(F.lit(1)).alias("n"),
        )
        several = spans.where("NOT (a <=> b) OR (dated > 0 AND dated < n)").select("id_disparo")
        shared = frozen(sent.join(several, "id_disparo", "left_semi").select(*names, PERIOD), "shared-ids")

        def sharing(of: set) -> DataFrame:
            return shared.join(shared.where(_in(of)).select("id_disparo").distinct(), "id_disparo", "left_semi")

        periods = periods | _periods(sharing(periods).select(PERIOD).distinct()) | self._orphaned(sent, periods)
        others = sharing(periods).where(~_in(periods))
        return sent.where(_in(periods)).select(*names).unionByName(others.select(*names)), periods

    def _orphaned(self, sent: DataFrame, periods: set) -> set:
        """Periods of dispatches whose id had its event in one of ``periods`` and has no row there now."""
        if self.version() < 0 or not periods:
            return set()
        here = sent.where(_in(periods)).select("id_disparo")
        had = self._read("events").where(_in(periods)).select("id_disparo")
        lost = frozen(had.join(here, "id_disparo", "left_anti"), "lost-ids")
        if lost.isEmpty():
            return set()
        return _periods(sent.join(lost, "id_disparo", "left_semi").select(PERIOD).distinct())
