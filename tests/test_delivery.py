import random

import pytest

from tallyweave.operators import delivery
from tallyweave.operators.delivery import exactly_once, split_by_frequency, surplus_pairs
from tallyweave.session import Scratch, clean_up

SCHEMA = "delivery_id long, txid string, v string, _id long, _row string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_surplus_and_kept(spark):
    df = rows(spark, [(5, "A ", "x", 1, "r"), (2, "a", "y", 1, "r"), (9, " a", None, 2, None), (3, None, "n", 3, "r"), (4, "", "e", 3, "r"), (6, "  ", "b", 3, "r"), (7, "b", "z", None, "r")])
    assert sorted(map(tuple, surplus_pairs(df).collect())) == [(2, 5), (2, 9)]
    kept = exactly_once(df)
    assert kept.columns == df.columns
    assert sorted(r.delivery_id for r in kept.collect()) == [2, 3, 4, 6, 7]


def test_equal_rows_leave_one(spark):
    df = rows(spark, [(1, "a", "x", 1, "r")] * 3 + [(None, "b", "x", 1, "r")] * 2)
    assert sorted((str(r.delivery_id), r.txid) for r in exactly_once(df).collect()) == [("1", "a"), ("None", "b")]
    assert surplus_pairs(df).count() == 0


def test_hot_identifier(spark):
    df = spark.range(6000).selectExpr("id delivery_id", "case when id % 3 = 0 then 'hot' else concat('t', id) end txid")
    pairs = surplus_pairs(df, hot_share=0.1).collect()
    assert len(pairs) == 1999 and {p.first_delivery_id for p in pairs} == {0}
    assert exactly_once(df).count() == 4001


def brute(data):
    best = {}
    for d, t, *_ in data:
        key = (t or "").strip().lower() or ("none", d)
        best[key] = min(best.get(key, d), d)
    return best


@pytest.mark.parametrize("most_bits", [28, 12, 1])
def test_full_bit_table_changes_nothing(spark, monkeypatch, most_bits):
    """With few bits singletons are ranked too; the rows stay the same."""
    monkeypatch.setattr(delivery, "_MAX_BITS", max(12, most_bits))
    if most_bits == 1:
        monkeypatch.setattr(delivery, "_bit_table", lambda hashes, bits: spark.createDataFrame([(0, [-1] * 64)], "block long, words array<long>"))
    rnd = random.Random(7)
    data = [(i, rnd.choice([None, "", f"T{rnd.randrange(900)}", f" t{rnd.randrange(900)} "]), "v", 0, "") for i in rnd.sample(range(9000), 3000)]
    df = rows(spark, data).repartition(5)
    best = brute(data)
    assert sorted(r.delivery_id for r in exactly_once(df).collect()) == sorted(best.values())
    key = lambda d, t: (t or "").strip().lower() or ("none", d)
    assert sorted(map(tuple, surplus_pairs(df, hot_share=0.2).collect())) == sorted((best[key(d, t)], d) for d, t, *_ in data if best[key(d, t)] != d)


def test_singletons_are_not_ranked(spark):
    df = spark.range(4000).selectExpr("id delivery_id", "concat('t', id % 3900) as _id")
    with Scratch(spark) as scratch:
        parts = split_by_frequency(df, scratch)
        n = parts.repeated.count()
        assert 200 <= n < 500 and parts.single.count() + n == 4000


def test_hot_identifier_fills_no_task(spark):
    """The ranking shuffle gets one row of the hot identifier per task, not a third of all rows."""
    df = spark.range(0, 60_000, 1, 12).selectExpr("id delivery_id", "case when id % 3 = 0 then 'hot' else concat('t', id div 2) end txid", "repeat('x', 50) v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        once = exactly_once(df)
        plan = once._jdf.queryExecution().executedPlan()
        # of the 40,000 other rows, ids 1 and 2, 4 and 5, ... share an identifier where both halves are equal
        assert once.count() == 1 + len({i // 2 for i in range(60_000) if i % 3})
        text = plan.toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # every exchange of rows lies above a partial aggregate
    lines = [x.strip(" :+-") for x in text.splitlines()]
    for k, line in enumerate(lines):
        if line.startswith("Exchange hashpartitioning"):
            assert "partial_min_by" in lines[k + 1], lines[k + 1]


def test_stored_and_new(spark):
    old, new = rows(spark, [(1, "a", "x", 1, "r")]), rows(spark, [(2, "A", "x", 1, "r"), (3, "c", "x", 1, "r")])
    assert sorted(r.delivery_id for r in exactly_once(new, stored=old).collect()) == [1, 3]


def test_empty(spark):
    df = rows(spark, [])
    assert surplus_pairs(df).count() == 0 and exactly_once(df).count() == 0


def test_scratch_leaves_what_is_held(spark):
    clean_up(spark)
    with Scratch(spark) as s:
        a = s.keep(spark.range(3).toDF("n"), "a")
        s.keep(spark.range(3).toDF("n"), "b")
        s.hold("a")
        gone = s._paths["b"]
    assert a.count() == 3 and not spark._jvm.java.io.File(gone.removeprefix("file://").removeprefix("file:")).exists()
    assert clean_up(spark) == 1 and clean_up(spark) == 0
