"""The visited-set filter against a plain anti-join."""

import pytest

from pagelake.operators import visited as V


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "url string").repartition(3)


@pytest.mark.parametrize("buckets", [1, 4, None])
def test_new_keys_equal_anti_join(spark, buckets):
    seen = keys(spark, [f"u{i}" for i in range(0, 9000, 3)] + [None, "é", ""])
    asked = keys(spark, [f"u{i}" for i in range(4000)] * 2 + [None, "é", "", "new"])
    known = V.VisitedFilter.of(seen, "url", buckets)
    got = sorted(str(r.url) for r in V.new_keys(asked, seen, "url", known).collect())
    assert got == sorted(str(r.url) for r in asked.join(seen, "url", "left_anti").collect())
    r = V.filter_report(asked, seen, "url", known).first()
    assert r.n_missed == 0 and r.n_keys == 4003 and r.n_passed + r.n_checked == r.n_keys
    assert r.n_false < 0.05 * r.n_keys and r.n_passed > 2500


def test_merged_filters(spark):
    a, b = keys(spark, [f"a{i}" for i in range(500)]), keys(spark, [f"b{i}" for i in range(500)])
    both = V.VisitedFilter.of(a, "url", 2).merge(V.VisitedFilter.of(b, "url", 2))
    once = V.VisitedFilter.of(a.unionByName(b), "url", 2)
    assert sorted(map(tuple, both.rows.collect())) == sorted(map(tuple, once.rows.collect()))
    with pytest.raises(ValueError):
        both.merge(V.VisitedFilter.of(a, "url", 4))


def test_empty_sides_and_large_filters(spark, monkeypatch):
    some, none = keys(spark, ["a", "b"]), keys(spark, ["a"]).limit(0)
    assert V.new_keys(some, none, "url").count() == 2
    assert V.new_keys(none, some, "url").count() == 0
    monkeypatch.setattr(V, "BROADCAST_BYTES", 1)  # too large to broadcast: the plain join
    known = V.VisitedFilter.of(some, "url")
    assert V.new_keys(keys(spark, ["a", "c"]), some, "url", known).collect()[0].url == "c"
    assert V.filter_report(keys(spark, ["a", "c"]), some, "url", known).first().n_checked == 1


def test_new_keys_are_not_shuffled(spark):
    """Keys that the filter does not know take no part in the exact join."""
    seen, asked = keys(spark, [f"u{i}" for i in range(1000)]), keys(spark, [f"v{i}" for i in range(1000)])
    known = V.VisitedFilter.of(seen, "url")
    assert known.flag(asked, "url").where("maybe_seen").count() < 20
