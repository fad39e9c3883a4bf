"""The commit log, merges by bucket, and constraints, on small fact tables."""

import threading
from datetime import date, datetime

import pytest

from tallyforge.operators import constraints, warehouse
from tallyforge.operators.constraints import ConstraintError, Rules
from tallyforge.schemas import WAREHOUSE
from tallyforge.sources.commits import CommitConflict
from tallyforge.sources.files import Files
from tallyforge.sources.storage import Change, Warehouse

AT = datetime(2024, 5, 1)
RUN = {"source_system": "s", "mode": "incremental", "started_at": AT, "finished_at": AT, "status": "succeeded", "args_json": "{}"}


def orders(spark, ids, run="r", customer=1):
    return spark.createDataFrame([(i, customer, AT.date(), AT, "PT", "paid", None, run, AT) for i in ids], WAREHOUSE["fact_orders"])


def merge(rows):
    return Change(rows, "merge", warehouse.RECONCILE["fact_orders"])


def facts(store):
    return {r.order_id: r.source_run_id for r in store.current()["fact_orders"].collect()}


def buckets_of(store, ids):
    spark = store.spark
    rows = spark.createDataFrame([(i,) for i in ids], "order_id bigint").select("order_id", store._bucket("fact_orders", store.buckets).alias("b"))
    return {r.order_id: r.b for r in rows.collect()}


@pytest.fixture
def store(spark, tmp_path):
    s = Warehouse(spark, tmp_path / "wh", buckets=4)
    s.publish(RUN | {"run_id": "base"}, lambda c: {"fact_orders": Change(orders(spark, range(40), "base"))})
    return s


def test_one_of_many_creates_a_file(spark, tmp_path):
    files, made = Files(spark, tmp_path), []
    files.make("x")
    threads = [threading.Thread(target=lambda k=k: made.append((files.create("x/1.json", str(k)), str(k)))) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [ok for ok, _ in made].count(True) == 1 and files.read("x/1.json") == next(k for ok, k in made if ok)
    assert files.names("x") == ["1.json"]


def other_run(store, rows, name="other"):
    Warehouse(store.spark, store.root, 4).publish(RUN | {"run_id": name}, lambda c: {"fact_orders": merge(rows)})


@pytest.mark.parametrize("same", [False, True])
def test_overtaken_merges(spark, store, same):
    at = buckets_of(store, range(40))
    mine = [i for i in at if at[i] == 0][:3]
    theirs = [i for i in at if at[i] == (0 if same else 1)][2:5]
    built = []

    def build(commit):
        built.append(commit.number)
        if len(built) == 1:
            other_run(store, orders(spark, theirs, "other"))
        return {"fact_orders": merge(orders(spark, mine, "mine"))}

    commit = store.publish(RUN | {"run_id": "mine"}, build)
    # other buckets: taken over as they are; the same bucket: built again on what the other run made of it
    assert built == ([0, 1] if same else [0]) and commit.number == 2
    got = facts(store)
    assert len(got) == 40 and all(got[i] == "mine" for i in mine) and all(got[i] == "other" for i in set(theirs) - set(mine))
    parts = commit.tables["fact_orders"].parts
    untouched = {str(b) for b in range(4)} - {"0", str(at[theirs[0]])}
    assert all(parts[b] == store.log.read(0).tables["fact_orders"].parts[b] for b in untouched)


def test_other_tables_are_taken_over(spark, store):
    built = []

    def build(commit):
        built.append(commit.number)
        if len(built) == 1:
            other_run(store, orders(spark, [1], "other"))
        return {"dim_date": Change(spark.createDataFrame([(date(2024, 5, 1), 2024, 5, 1, 18, 3, 2, date(2024, 4, 29), date(2024, 5, 1), AT)], WAREHOUSE["dim_date"]), "append")}

    store.publish(RUN | {"run_id": "dates"}, build)
    assert built == [0] and facts(store)[1] == "other" and store.current()["dim_date"].count() == 1
    assert {r.run_id for r in store.ledger().where("status = 'succeeded'").collect()} == {"base", "other", "dates"}


def test_always_overtaken(spark, store):
    k = iter(range(99))

    def build(commit):
        other_run(store, orders(spark, [1], "other"), f"o{next(k)}")
        return {"fact_orders": merge(orders(spark, [1], "mine"))}

    before = set(store.files.names("fact_orders"))
    with pytest.raises(CommitConflict):
        store.publish(RUN | {"run_id": "mine"}, build, attempts=2)
    assert facts(store)[1] == "other" and len(set(store.files.names("fact_orders")) - before) == 2  # those of the other runs


def test_broken_rules_publish_nothing(spark, store):
    before = store.files.names("fact_orders")
    for rows, rule in ((orders(spark, [1, 1]), "unique(order_id)"), (orders(spark, [1], customer=None), "not_null(customer_id)"), (orders(spark, [1], run=None), "not_null(source_run_id)")):
        with pytest.raises(ConstraintError) as e:
            store.publish(RUN | {"run_id": "bad"}, lambda c, rows=rows: {"fact_orders": Change(rows)})
        assert e.value.broken == {rule: 1} and rule in str(e.value)
    assert store.files.names("fact_orders") == before and store.log.latest().number == 0


def test_check_before_the_commit(spark, store):
    def check(commit):
        assert commit.number == 1 and store.table("fact_orders", commit.tables["fact_orders"]).count() == 41
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        store.publish(RUN | {"run_id": "x"}, lambda c: {"fact_orders": merge(orders(spark, [99]))}, check)
    assert len(facts(store)) == 40


def test_violations(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id bigint")
    child = spark.createDataFrame([(1, 1, 5), (1, 3, None), (2, None, -1), (None, 2, 7)], "a bigint, parent bigint, n int")
    rules = {"child": Rules(("a",), (("positive", "n > 0"),), ("a",), (("parent", "parents", "id"),))}
    got = {r.rule: r.n for r in constraints.violations({"child": child, "parents": parent}, rules).collect()}
    assert got == {"not_null(a)": 1, "check(positive)": 1, "unique(a)": 1, "references(parent: parents.id)": 1}
    with pytest.raises(ConstraintError) as e:
        constraints.enforce({"child": child, "parents": parent}, rules)
    assert e.value.broken == got and e.value.table == "child"
    constraints.enforce({"child": child.limit(0), "parents": parent}, rules)
    with pytest.raises(ValueError):
        constraints.violations({"parents": parent}, rules)
    ledger = spark.createDataFrame([("r", "s", "weekly", AT, "gone", "{}", AT, datetime(2024, 4, 1))], "run_id string, source_system string, mode string, started_at timestamp, status string, args_json string, watermark_low timestamp, watermark_high timestamp")
    assert {r.rule for r in constraints.violations({"run_ledger": ledger}).where("n > 0").collect()} == {"check(mode)", "check(status)", "check(window)"}
