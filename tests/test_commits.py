"""Two writers lose nothing; locks pass on with a larger number."""

import json

import pytest
from pyspark.sql import functions as F

from tidewire.operators import queues, serving, tables


def jobs(spark):
    rows = [(i, "embed", "queued", 0, 3, None, None, "2024-01-01 00:00:00", i) for i in range(6)]
    out = spark.createDataFrame(rows, "job_id bigint, job_type string, status string, attempts int, max_attempts int, worker string, lease_expires_at string, available_at string, priority int")
    return out.withColumns({c: F.col(c).cast("timestamp") for c in ("lease_expires_at", "available_at")})


def mark(rows, job_id, worker):
    return rows.withColumns({"status": F.when(F.col("job_id") == job_id, "leased").otherwise(F.col("status")), "worker": F.when(F.col("job_id") == job_id, worker).otherwise(F.col("worker"))})


def test_a_write_on_an_old_version_is_refused(spark, tmp_path):
    one, two = (tables.Snapshots(spark, f"file://{tmp_path}/t") for _ in range(2))
    assert one.write(jobs(spark)) == 1
    at = one.version()
    a, b = mark(one.read(at), 1, "A"), mark(two.read(at), 2, "B")
    assert one.write(a, expected=at) == 2
    folders = set(one._names("rows"))
    with pytest.raises(tables.Conflict):
        two.write(b, expected=at)
    assert set(one._names("rows")) == folders  # a refused writer leaves nothing behind
    assert two.update(lambda rows: mark(rows, 2, "B")) == 3
    assert {(r.job_id, r.worker) for r in one.read().where("status = 'leased'").collect()} == {(1, "A"), (2, "B")}


def test_two_writers_between_read_and_write(spark, tmp_path):
    """Another writer commits while the first one works: the first one starts again."""
    one, two = (tables.Snapshots(spark, f"file://{tmp_path}/t") for _ in range(2))
    one.write(jobs(spark))
    seen = []

    def change(rows):
        if len(seen) < 2:
            two.update(lambda r, n=len(seen): mark(r, n, f"other{n}"))
        seen.append(1)
        return mark(rows, 5, "me")

    one.update(change)
    assert len(seen) == 3 and one.version() == 4
    assert {(r.job_id, r.worker) for r in one.read().where("worker IS NOT NULL").collect()} == {(0, "other0"), (1, "other1"), (5, "me")}
    with pytest.raises(tables.Conflict):
        one.update(lambda rows: two.write(rows) and rows, tries=2)


def test_leases_through_update_are_never_given_twice(spark, tmp_path):
    store = tables.Snapshots(spark, f"file://{tmp_path}/t")
    store.write(jobs(spark))
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    other = tables.Snapshots(spark, f"file://{tmp_path}/t")
    first = []

    def lease(worker):
        return lambda rows: mark(rows, rows.where("status = 'queued'").agg(F.min("job_id")).first()[0], worker)

    def slow(rows):
        out = lease("slow")(rows)
        if not first:
            first.append(other.update(lease("quick")))
        return out

    store.update(slow)
    assert sorted((r.worker, r.job_id) for r in store.read().where("status = 'leased'").collect()) == [("quick", 0), ("slow", 1)]
    done = spark.createDataFrame([(0,)], "job_id bigint")
    store.update(lambda rows: queues.complete(rows, done))
    assert store.read().where("status = 'done'").first().job_id == 0
    assert queues.reap(store.read(), now).count() == 6


def test_a_claim_without_a_list_is_freed(spark, tmp_path):
    import os

    store = tables.Snapshots(spark, f"file://{tmp_path}/t")
    store.write(jobs(spark))
    claim = tmp_path / "t" / "done" / "2"
    claim.touch()
    assert store.version() == 1
    with pytest.raises(tables.Conflict):
        store.write(jobs(spark))
    os.utime(claim, (0, 0))
    assert store.write(jobs(spark)) == 2


def test_locks_pass_on(spark, tmp_path):
    one, two = (tables.Lock(spark, f"file://{tmp_path}/poll") for _ in range(2))
    a = one.acquire(100.0, 30)
    assert a == 1 and two.acquire(110.0, 30) is None and one.holds(a, 129.0) and not one.holds(a, 131.0)
    assert one.extend(a, 120.0, 30) and two.acquire(140.0, 30) is None
    b = two.acquire(151.0, 30)
    assert b == 2 and not one.holds(a, 151.0) and not one.extend(a, 152.0, 30)
    store = tables.Snapshots(spark, f"file://{tmp_path}/t")
    with pytest.raises(tables.Conflict):
        store.write(jobs(spark), fence=(one, a, 152.0))  # it was slow, and another runs by now
    assert store.version() == 0 and store.write(jobs(spark), fence=(two, b, 152.0)) == 1
    one.release(a)
    assert two.holds(b, 153.0)
    two.release(b)
    assert one.acquire(154.0, 30) == 3


def test_kinds_that_forbid_commerce_have_no_limit(spark, tmp_path):
    names = [{"name": f"k{i}", "forbids_commercial": i % 2 == 0} for i in range(3000)] + [{"name": "silent"}, {"forbids_commercial": True}]
    (tmp_path / "kinds.json").write_text(json.dumps(names))
    kinds = serving.kinds_from_json(spark, f"file://{tmp_path}/kinds.json")
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(["k0", "k2998", "k2999", "silent", None, "new"])], "id bigint, kind string")
    assert sorted(r.id for r in serving.without_commerce(rows, "kind", serving.forbidding(kinds)).collect()) == [2, 3, 5]
