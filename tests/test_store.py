import random
from datetime import date, datetime, timedelta

import pytest
from frames import appearances, dispatch, some_time
from pyspark.sql import functions as F

from dialwise.operators import attribution
from dialwise.operators import profiles as pf
from dialwise.operators import ranking as rk
from dialwise.operators import rates as rt
from dialwise.operators.attribution import attribute_system, phone_histories
from dialwise.plans import store as store_module
from dialwise.plans.store import EventStore
from dialwise.session import file_system, new_table_path


def rows_of(df):
    return sorted(map(repr, df.collect()))


def check(store, sent, listed):
    """The store holds what a full pass gives."""
    want = attribute_system(sent, listed, store.null_dates)
    assert rows_of(store.read()) == rows_of(want)
    assert rows_of(store.read("profiles")) == rows_of(pf.daily_profile(want).select(*store.read("profiles").columns))


def at(day, hour=0):
    return datetime(2024, 1, 1) + timedelta(days=day, hours=hour)


def day(n):
    return date(2024, 1, 1) + timedelta(days=n)


SENT = [(i, i % 7, 10 + i % 5, at(i % 6, i % 3), ["read", "failed", None][i % 3]) for i in range(60)]
LISTED = [(10 + p, "21", s, at(-30 + 9 * s), 1) for p in range(4) for s in range(3)]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def store(spark):
    return EventStore(spark, new_table_path(spark, "store"))


def files(store, name="events"):
    """The files of each day, by folder."""
    found = {}
    system, folder = file_system(store.spark, f"{store.path}/{name}")
    for entry in system.listStatus(folder):
        if "=" in entry.getPath().getName():
            inner = system.listStatus(entry.getPath())
            found[entry.getPath().getName()] = {f.getPath().getName() for f in inner}
    return found


def test_a_new_day_rewrites_only_itself(spark, store):
    with pytest.raises(FileNotFoundError):
        store.read()
    listed = appearances(spark, LISTED)
    first = store.update(dispatch(spark, SENT), listed)
    assert first.version == 0 and first.periods == tuple(day(n) for n in range(6))
    assert first.new_dispatches == 60 and first.changed_phones == 4
    check(store, dispatch(spark, SENT), listed)
    before = files(store)
    more = SENT + [(100 + i, 1, 10 + i, at(6), "read") for i in range(4)]
    update = store.update(dispatch(spark, more), listed)
    assert update.periods == (day(6),) and update.new_dispatches == 4 and update.changed_phones == 0
    check(store, dispatch(spark, more), listed)
    assert {k: v for k, v in files(store).items() if k != "periodo=2024-01-07"} == before
    again = store.update(dispatch(spark, more), listed)
    assert again.periods == () and again.version == 2
    check(store, dispatch(spark, more), listed)


def test_a_late_update_of_the_dimension_rewrites_the_days_it_changes(spark, store):
    store.update(dispatch(spark, SENT), appearances(spark, LISTED))
    # Phone 11 has dispatches on every day; a record of day 3 changes those from then on.
    late = LISTED + [(11, "21", 8, at(3), 1)]
    update = store.update(dispatch(spark, SENT), appearances(spark, late))
    assert update.periods == (day(3), day(4), day(5)) and update.changed_phones == 1
    check(store, dispatch(spark, SENT), appearances(spark, late))
    # A record after all dispatches changes nothing; a phone that was unknown changes all its days.
    later = late + [(11, "21", 9, at(40), 1)]
    assert store.update(dispatch(spark, SENT), appearances(spark, later)).periods == ()
    known = later + [(14, "22", 1, at(50), 1)]
    assert store.update(dispatch(spark, SENT), appearances(spark, known)).periods == tuple(map(day, range(6)))
    check(store, dispatch(spark, SENT), appearances(spark, known))
    # An attribute of a phone reaches all of its events.
    moved = [(p, "99" if p == 10 else a, *rest) for p, a, *rest in known]
    store.update(dispatch(spark, SENT), appearances(spark, moved))
    check(store, dispatch(spark, SENT), appearances(spark, moved))


def test_changed_gone_and_undated_dispatches(spark, store):
    listed = appearances(spark, LISTED)
    odd = [*SENT, (200, 1, 10, None, "read"), (201, 1, None, at(2), "read"), (None, 1, 10, at(2), "read")]
    store.update(dispatch(spark, odd), listed)
    check(store, dispatch(spark, odd), listed)
    left = [r for r in odd if r[3] is not None and r[3].date() != day(4)]
    left[0] = (*left[0][:4], "failed")
    update = store.update(dispatch(spark, left), listed)
    assert update.periods == (None, day(0), day(4))
    check(store, dispatch(spark, left), listed)
    assert "periodo=2024-01-05" not in files(store)
    store.update(dispatch(spark, []), appearances(spark, []))
    assert store.read().count() == 0 and store.read("profiles").count() == 0


def test_rows_that_share_an_id_over_days(spark, store):
    """The better attribution may move from one day to another."""
    sent = [(1, 1, 10, at(0), "read"), (1, 1, 12, at(5), "read"), (1, 1, 13, at(3), "read"), *SENT[10:]]
    few = [(12, "21", 1, at(4), 1)]
    store.update(dispatch(spark, sent), appearances(spark, few))
    check(store, dispatch(spark, sent), appearances(spark, few))
    more = few + [(10, "21", 1, at(-1), 1)]
    store.update(dispatch(spark, sent), appearances(spark, more))
    check(store, dispatch(spark, sent), appearances(spark, more))
    fewer = [r for r in sent if r[2] != 12 or r[0] != 1]
    store.update(dispatch(spark, fewer), appearances(spark, more))
    check(store, dispatch(spark, fewer), appearances(spark, more))


def test_random_updates_equal_a_full_rebuild(spark):
    rng = random.Random(5)
    store = EventStore(spark, new_table_path(spark, "store"), "last")
    sent, listed = [], []
    for _ in range(2):
        sent = [r for r in sent if rng.random() > 0.05]
        listed = [r for r in listed if rng.random() > 0.05]
        sent += [
            (rng.randrange(60), 1, rng.choice([None, *range(8)]), rng.choice([None, some_time(rng, days=9)]), "read")
            for _ in range(25)
        ]
        listed += [
            (rng.randrange(7), "21", rng.choice([None, 1, 2]), rng.choice([None, some_time(rng, days=9)]), 1)
            for _ in range(12)
        ]
        store.update(dispatch(spark, sent), appearances(spark, listed))
        check(store, dispatch(spark, sent), appearances(spark, listed))


def test_a_store_by_month(spark):
    store = EventStore(spark, new_table_path(spark, "store"), unit="month")
    sent = [(i, 1, 10 + i % 3, at(9 * i), "read") for i in range(20)] + [(99, 1, 10, None, "read")]
    listed = appearances(spark, LISTED)
    store.update(dispatch(spark, sent[:15]), listed)
    update = store.update(dispatch(spark, sent), listed)
    assert update.periods == (None, date(2024, 5, 1), date(2024, 6, 1))
    check(store, dispatch(spark, sent), listed)


def test_an_update_that_broke_off_is_done_again(spark, store, monkeypatch):
    listed = appearances(spark, LISTED)
    store.update(dispatch(spark, SENT), listed)
    more = SENT + [(100, 1, 10, at(6), "read")]
    real = store._replace

    def fails(*args):
        real(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "_replace", fails)
    with pytest.raises(RuntimeError):
        store.update(dispatch(spark, more), listed)
    assert store.version() == 0
    monkeypatch.setattr(store, "_replace", real)
    assert store.update(dispatch(spark, more), listed).periods == (day(6),)
    check(store, dispatch(spark, more), listed)


def test_an_update_builds_the_histories_once(spark, store, monkeypatch):
    built = []

    def counted(*args):
        built.append(args)
        return phone_histories(*args)

    with monkeypatch.context() as patched:
        for module in (attribution, store_module):
            patched.setattr(module, "phone_histories", counted)
        first = store.update(dispatch(spark, SENT), appearances(spark, LISTED))
        assert (len(built), first.changed_phones) == (1, 4)
        late = [*LISTED, (10, "21", 8, at(2), 1)]
        assert store.update(dispatch(spark, SENT), appearances(spark, late)).changed_phones == 1
        assert len(built) == 2
    check(store, dispatch(spark, SENT), appearances(spark, late))


def test_profiles_merge_in_any_order(spark):
    events = attribute_system(dispatch(spark, SENT), appearances(spark, LISTED))
    whole = pf.daily_profile(events)
    parts = [pf.daily_profile(events.where(F.col("id_disparo") % 3 == i)) for i in range(3)]
    for order in ((0, 1, 2), (2, 0, 1)):
        one = pf.merged(*[parts[i] for i in order])
        assert rows_of(one.select(*whole.columns)) == rows_of(whole)
        assert rows_of(pf.system_rates(one)) == rows_of(rt.rates_by_system(events))
        assert rows_of(pf.age_rates(one)) == rows_of(rt.rates_by_age(events))
        assert rows_of(pf.baseline(one)) == rows_of(rk.baseline_rate(events))


def test_sketches_unite_and_stay_within_their_bound(spark):
    people = spark.range(60_000).selectExpr(
        "pmod(xxhash64(id), 20000) AS cpf", "date_add(DATE'2024-01-01', CAST(id % 7 AS INT)) AS envio_data",
        "IF(id % 4 = 3, NULL, id % 4) AS id_sistema_mask",
    )
    sketches = pf.people_sketches(people.unionByName(people.withColumn("cpf", F.lit(None).cast("long"))))
    assert sketches.count() == 28
    exact = people.groupBy("id_sistema_mask").agg(F.count_distinct("cpf").alias("n")).collect()
    got = {r["id_sistema_mask"]: r["people"] for r in pf.estimated_people(sketches, "id_sistema_mask").collect()}
    assert set(got) == {r["id_sistema_mask"] for r in exact}
    for row in exact:
        assert abs(got[row["id_sistema_mask"]] - row["n"]) <= 4 * 1.04 / 64 * row["n"]
    total = pf.estimated_people(sketches).first()["people"]
    assert abs(total - people.select("cpf").distinct().count()) <= 4 * 1.04 / 64 * 20_000
