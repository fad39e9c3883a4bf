import io
import json
import time
import urllib.error
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import PySparkException

from shop import bundle, cart, serving

from tallyforge.operators import mappings
from tallyforge.sources import adapters, paging, snapshot
from tallyforge.sources.files import Files
from tallyforge.sources.landing import Landing, PageTaken, open_window
from tallyforge.sources.window import ExtractionWindow

LOW, HIGH = datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 1, 2, tzinfo=timezone.utc)
WINDOW = ExtractionWindow("updated_at", LOW, HIGH, None, timedelta(0), True)


def test_snapshot_round_trip(spark, tmp_path):
    files = snapshot.write_snapshot(spark, bundle(), tmp_path, 5)
    body = json.load(open(files["carts"]))
    assert (body["total"], body["skip"], body["limit"], body["carts"]) == (1, 0, 5, bundle()["carts"])
    r = snapshot.read_snapshot(spark, tmp_path)
    tables, rejects = mappings.stage_all(r)
    assert [t.count() for t in tables.values()] == [1, 1, 1, 1] and rejects.count() == 0
    o = tables["stg_orders"].first()
    assert (o.order_id, o.country, o.status, str(o.order_ts)) == (57, "Portugal", "paid", "2024-02-27 01:48:57")


def test_snapshot_at_a_uri(spark, tmp_path):
    snapshot.write_snapshot(spark, bundle() | {"users": []}, f"file://{tmp_path}/x")
    assert snapshot.read_resource(spark, f"file://{tmp_path}/x", "users").count() == 0
    assert snapshot.read_resource(spark, f"file://{tmp_path}/x", "carts").first().id == "57"


@pytest.mark.parametrize("name,field,value", [("users", "lastName", " "), ("products", "price", -1), ("products", "stock", 1.5), ("carts", "userId", 0)])
def test_one_invalid_record_fails_the_page(spark, tmp_path, name, field, value):
    b = bundle()
    b[name][0][field] = value
    snapshot.write_snapshot(spark, b, tmp_path)
    with pytest.raises(ValueError, match="invalid"):
        snapshot.read_resource(spark, tmp_path, name)


def many(n):
    return bundle() | {"carts": [cart(k, 1.0) for k in range(1, n + 1)]}


def test_pages_are_read_by_partitions(spark):
    with serving(many(23)) as (url, asked):
        rows = adapters.ShopSource(url, interval_s=0, readers=3).pages(spark, "carts", 5)
        assert rows.rdd.getNumPartitions() == 3
        got = sorted((r.source_ref, json.loads(r.raw_payload)["id"]) for r in rows.collect())
        assert got == [(k, k) for k in range(1, 24)]
        assert {p.split("skip=")[1] for p in asked} == {"0", "5", "10", "15", "20"}
        assert adapters.ShopSource(url, interval_s=0).pages(spark, "users", 5).count() == 1
    with serving(bundle() | {"users": []}) as (url, _):
        assert adapters.ShopSource(url, interval_s=0).pages(spark, "users", 5).count() == 0


def test_a_server_may_give_smaller_pages(spark):
    def smaller(page):
        return page | {"limit": 2, "carts": page["carts"][:2]}

    with serving(many(7), smaller) as (url, _):
        assert sorted(r.source_ref for r in adapters.ShopSource(url, interval_s=0).pages(spark, "carts", 5).collect()) == list(range(1, 8))


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda p: p | {"total": p["total"] + (p["skip"] > 0)}, "total changed"),
        (lambda p: p | {"skip": 0}, "asked for"),
        (lambda p: p | {"carts": None}, "not a page"),
        (lambda p: p | {"total": True}, "not a page"),
        (lambda p: p | {"total": 10**6}, "more than"),
    ],
)
def test_drift_and_wrong_pages(spark, change, message):
    with serving(many(12), change) as (url, _), pytest.raises(PySparkException, match=message):
        adapters.ShopSource(url, interval_s=0).pages(spark, "carts", 5).collect()


def test_readers_share_the_request_rate(spark):
    times = []

    def status(n, path):
        times.append(time.monotonic())
        return 200, {}

    with serving(many(24), status=status) as (url, _):
        adapters.ShopSource(url, interval_s=0.1, readers=4).pages(spark, "carts", 2).collect()
    reads = sorted(times)[-12:]
    assert len(reads) == 12 and reads[-1] - reads[0] >= 2 * 0.4 - 0.05  # three requests each, four intervals apart


def test_retries(spark):
    with serving(bundle(), status=lambda n, path: (429, {"Retry-After": "0"}) if n % 2 else (200, {})) as (url, asked):
        assert adapters.ShopSource(url, interval_s=0).pages(spark, "users", 5).count() == 1 and len(asked) == 4
    waited, answers = [], [503, "reset", 500, 200]

    def get(url, timeout):
        a = answers.pop(0)
        if a == "reset":
            raise ConnectionResetError
        if a != 200:
            raise urllib.error.HTTPError(url, a, "", {}, None)
        return io.BytesIO(b'{"x": 1}')

    client = paging.Client("http://x", sleep=waited.append, clock=lambda: 0.0, opener=get)
    assert client.get("users", 1, 0) == {"x": 1}
    delays = [w for w in waited if w != client.interval]
    assert [round(d // 0.5) for d in delays] in ([1, 2, 4], [1, 2, 5]) and all(b <= d <= b * 1.25 for b, d in zip((0.5, 1, 2), delays))
    for answer in (404, 401):
        answers[:] = [answer]
        with pytest.raises(urllib.error.HTTPError):
            client.get("users", 1, 0)
    answers[:] = [500] * 9
    with pytest.raises(urllib.error.HTTPError):
        client.get("users", 1, 0)
    assert len(answers) == 5


def test_extracted_snapshots(spark, tmp_path):
    with serving(many(7)) as (url, _):
        files = adapters.extract_snapshots(spark, str(tmp_path / "snap"), adapters.ShopSource(url, interval_s=0), 2)
    assert set(files) == {"users", "products", "carts"}
    assert [(r.id, r.source_ref) for r in snapshot.read_resource(spark, tmp_path / "snap", "carts").orderBy("source_ref").collect()] == [(str(k), k) for k in range(1, 8)]


def test_snapshots_of_many_files(spark, tmp_path):
    snapshot.write_snapshot(spark, bundle(), tmp_path / "snap")
    rows = snapshot.read_resource(spark, tmp_path / "snap", "carts")
    rows.drop("raw_payload").write.json(str(tmp_path / "big" / "carts.jsonl"))
    got = snapshot.read_resource(spark, tmp_path / "big", "carts").first()
    assert (got.id, got.source_ref, got.products[0].quantity) == ("57", 1, "3")
    with pytest.raises(FileNotFoundError):
        snapshot.read_resource(spark, tmp_path / "big", "users")
    assert snapshot.snapshot_root_for_key("v1", "/x") == "/x/dummyjson/v1"


def searched(n, asked, fail_at=None):
    """post() of a service with n pages of one order each, which fails at a page."""

    def post(url, body, headers):
        k = int(body.get("cursor", "c0")[1:])
        asked.append(k)
        if k == fail_at:
            raise ConnectionError("gone")
        return {"orders": [{"id": f"o{k}"}]} | ({"cursor": f"c{k + 1}"} if k + 1 < n else {})

    return post


def test_order_search(spark, tmp_path):
    seen = []

    def post(url, body, headers):
        seen.append(body)
        return {"orders": [{"id": f"o{len(seen)}", "total_money": {"amount": 5}}]} | ({"cursor": f"c{len(seen)}"} if len(seen) < 3 else {})

    s = adapters.OrderSearchSource("token", ("a", "b"), post=post)
    got = s.pull_incremental(spark, 5000, WINDOW, Landing(Files(spark, tmp_path), "s", WINDOW, "r"))
    assert [(o.id, o.total_money.amount) for o in got.records["orders"].orderBy("source_ref").collect()] == [("o1", 5), ("o2", 5), ("o3", 5)]
    assert [b.get("cursor") for b in seen] == [None, "c1", "c2"] and seen[0]["limit"] == 1000 and seen[0]["query"]["sort"]["sort_field"] == "UPDATED_AT"
    assert seen[0]["query"]["filter"]["date_time_filter"] == {"updated_at": {"start_at": "2024-01-01T00:00:00+00:00", "end_at": "2024-01-02T00:00:00+00:00"}}
    assert got.meta["pages"] == 3 and got.meta["pages_of_earlier_pulls"] == 0
    with pytest.raises(ValueError):
        s.validate_watermark_column("order_ts")
    with pytest.raises(NotImplementedError):
        s.pull_full(None, 1, None)


@pytest.mark.parametrize("fail_at", [0, 1, 3, 5])
def test_a_pull_goes_on_where_it_ended(spark, tmp_path, fail_at):
    files, asked, states = Files(spark, tmp_path), [], []
    first = adapters.OrderSearchSource("t", ("a",), post=searched(6, asked, fail_at))
    with pytest.raises(ConnectionError):
        first.pull_incremental(spark, 1, WINDOW, Landing(files, "s", WINDOW, "r1", states.append))
    assert asked == list(range(fail_at + 1)) and [x["pages"] for x in states] == list(range(1, fail_at + 1))
    again = open_window(files, "s", "updated_at")
    assert again == WINDOW
    asked.clear()
    second = adapters.OrderSearchSource("t", ("a",), post=searched(6, asked))
    got = second.pull_incremental(spark, 1, again, Landing(files, "s", again, "r2", states.append))
    assert asked == list(range(fail_at, 6)) and states[-1]["done"] and got.meta["pages_of_earlier_pulls"] == fail_at
    assert sorted(o.id for o in got.records["orders"].collect()) == [f"o{k}" for k in range(6)]
    assert open_window(files, "s", "updated_at") is None
    asked.clear()
    third = second.pull_incremental(spark, 1, WINDOW, Landing(files, "s", WINDOW, "r3"))  # all is there
    assert asked == [] and third.records["orders"].count() == 6


def test_two_pulls_of_one_window(spark, tmp_path):
    files, asked = Files(spark, tmp_path), []
    other = Landing(files, "s", WINDOW, "r2")

    def page(cursor):
        if cursor == "c2":
            other.pull(lambda c: ([{"id": "x"}], None), 9)
        return searched(4, asked)("", {"cursor": cursor or "c0"}, {})["orders"], f"c{len(asked)}"

    with pytest.raises(PageTaken):
        Landing(files, "s", WINDOW, "r1").pull(page, 9)


def test_circles_and_endless_pages(spark, tmp_path):
    with pytest.raises(RuntimeError, match="twice"):
        Landing(Files(spark, tmp_path / "a"), "s", WINDOW, "r").pull(lambda c: ([], "same"), 9)
    with pytest.raises(RuntimeError, match="more than 9"):
        Landing(Files(spark, tmp_path / "b"), "s", WINDOW, "r").pull(lambda c: ([], f"{c}x"), 9)
