"""Differences of recorded answers."""

from tidewire.operators import golden


def diff(spark, was, now, volatile=None):
    frame = lambda rows: spark.createDataFrame(rows, "key string, status int, body string")
    out = golden.differences(golden.capture(frame(was), volatile), golden.capture(frame(now), volatile))
    return sorted((r.key, r.path, r.kind, r.was, r.now) for r in out.collect())


def test_paths_that_changed(spark):
    was = [("a", 200, '{"x":1,"l":[1,2],"o":{"k":"é","t":5},"e":{},"n":null}'), ("b", 200, "[]"), ("gone", 200, '{"y":1}'), ("text", 500, "oops")]
    now = [("a", 200, '{"l":[1,3,4],"x":1.5,"o":{"k":"é","t":6},"e":[],"n":null}'), ("b", 401, "[]"), ("text", 500, "other"), ("new", None, None)]
    assert diff(spark, was, now, ["t"]) == [
        ("a", "$.e", "changed", "{}", "[]"), ("a", "$.l[1]", "changed", "2", "3"), ("a", "$.l[2]", "extra", None, "4"), ("a", "$.x", "changed", "1", "1.5"),
        ("b", "$status", "changed", "200", "401"), ("gone", "$.y", "missing", "1", None), ("gone", "$status", "missing", "200", None), ("text", "$text", "changed", "oops", "other"),
    ]
    assert diff(spark, was, was) == []


def test_lists_of_named_objects_have_no_order(spark):
    was = [("k", 200, '{"l":[{"id":1,"v":[{"id":"x","z":1}]},{"id":2,"v":2}],"m":[{"id":1},{"id":1}]}')]
    now = [("k", 200, '{"l":[{"v":2,"id":2},{"id":1,"v":[{"id":"x","z":9}]},{"id":3}],"m":[{"id":1},{"id":1}]}')]
    assert diff(spark, was, now) == [("k", "$.l[id=1].v[id=x].z", "changed", "1", "9"), ("k", "$.l[id=3].id", "extra", None, "3")]


def test_a_capture_reads_its_answers_once(spark):
    rows = spark.createDataFrame([("a", 200, '{"t":1,"x":[{"id":"p","t":2},{"id":"q","y":1.5}]}'), ("b", None, "oops"), ("c", 204, None)], "key string, status int, body string")
    out = golden.capture(rows, ["t"])
    assert sorted((r.key, r.path, r.value) for r in out.collect()) == [
        ("a", "$.t", '"*"'), ("a", "$.x[id=p].id", '"p"'), ("a", "$.x[id=p].t", '"*"'), ("a", "$.x[id=q].id", '"q"'), ("a", "$.x[id=q].y", "1.5"), ("a", "$status", "200"),
        ("b", "$text", "oops"), ("c", "$status", "204"),
    ]
    plan = golden.differences(out, out)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "EvalPython" not in plan and "Join" not in plan


def test_a_null_key_is_compared(spark):
    assert diff(spark, [(None, 200, "[1]")], [(None, 200, "[2]")]) == [(None, "$[0]", "changed", "1", "2")]
