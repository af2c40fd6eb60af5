import random

from pyspark.sql import functions as F

import replay
from kbcurate.functions import dates as D


def made(rng, levels=range(0, 14)):
    p = rng.choice(list(levels))
    y = rng.choice([1890, 1900, 1901, 1950, 1989, 1990, 1999, 2000, 2001, 2010])
    m = rng.choice([None, 1, 2, 12]) if p >= 10 else None
    d = rng.choice([None, 1, 28, 30]) if p >= 11 else None
    return (p, y, m, d)


def rows(spark, pairs):
    data = [
        (i, replay.time(a), a and a[0], replay.time(b), b and b[0]) for i, (a, b) in enumerate(pairs)
    ]
    df = spark.createDataFrame(data, "i int, at string, ap int, bt string, bp int")
    return df.select(
        "i", D.imprecise(F.col("at"), F.col("ap")).alias("a"),
        D.imprecise(F.col("bt"), F.col("bp")).alias("b"),
    )


def test_predicates_and_keys_agree_with_the_rules(spark):
    rng = random.Random(5)
    pairs = [(made(rng), made(rng)) for _ in range(1500)]
    pairs += [(None, made(rng)), (made(rng), None), (None, None)]
    own_a, own_b = D.own_key("a"), D.own_key("b")
    fine = F.size(F.array_intersect(D.container_keys("a"), D.ancestor_keys("b")))
    coarse = F.size(F.array_intersect(D.ancestor_keys("a"), D.container_keys("b")))
    got = rows(spark, pairs).select(
        "i", D.could_be_same(F.col("a"), F.col("b")).alias("same"),
        D.finer(F.col("a"), F.col("b")).alias("finer"), D.consecutive(F.col("a"), F.col("b")).alias("adj"),
        (own_a == own_b).alias("eq"), fine.alias("fine"), coarse.alias("coarse"),
    ).collect()
    for r in got:
        a, b = pairs[r.i]
        assert r.same == replay.same(a, b), (a, b)
        assert r.finer == replay.finer(a, b)
        if a and b:
            assert r.adj == replay.adjoin(a, b), (a, b)
        # each true pair is one relation of keys, found exactly once
        assert int(r.eq) + r.fine + r.coarse == int(replay.same(a, b)), (a, b, r)


def test_exactly_n_years_is_not_over(spark):
    data = [("+2019-01-31T00:00:00Z", 11, False), ("+2019-01-30T00:00:00Z", 11, True),
            ("+2019-01-00T00:00:00Z", 10, False), ("+2018-12-00T00:00:00Z", 10, True),
            ("+2019-00-00T00:00:00Z", 9, False), ("+2018-00-00T00:00:00Z", 9, True),
            ("+2010-00-00T00:00:00Z", 8, False), ("+2000-00-00T00:00:00Z", 8, True),
            ("-0044-03-15T00:00:00Z", 11, True), ("+1900-00-00T00:00:00Z", 11, False)]
    df = spark.createDataFrame(data, "t string, p int, want boolean")
    d = D.imprecise(F.col("t"), F.col("p"))
    bad = df.where(D.over_years_ago(d, 5, F.lit("2024-01-31").cast("date")) != F.col("want"))
    assert bad.collect() == []


def test_unsigned_strings_are_no_dates_and_the_sign_is_dropped(spark):
    df = spark.createDataFrame([("1970-01-15", "-0044-00-00T00:00:00Z", "+0044-00-00T00:00:00Z")], "a string, b string, c string")
    p = F.lit(9)
    row = df.select(
        D.imprecise(F.col("a"), p).isNull().alias("none"),
        D.could_be_same(D.imprecise(F.col("b"), p), D.imprecise(F.col("c"), p)).alias("same"),
    ).first()
    assert row.none and row.same


def test_shown_forms(spark):
    df = spark.createDataFrame([("+2020-03-15T00:00:00Z", 11)], "t string, p int")
    d = D.imprecise(F.col("t"), F.col("p"))
    row = df.select(
        D.display(d), D.long_date(d), D.timeframe_text(d, D.no_date()), D.timeframe_text(D.no_date(), d),
        D.long_range(d, D.no_date()), D.long_range(D.no_date(), D.no_date()),
    ).first()
    assert tuple(row) == (
        "2020-03-15", "March 15, 2020", " (2020-03-15 - present)", " (until 2020-03-15)",
        "March 15, 2020 – present", "dates not specified",
    )


def test_qualifiers_without_value_are_absent(spark):
    df = spark.createDataFrame([('{"P580":[{"snaktype":"somevalue"}]}',), ("{}",), (None,)], "q string")
    assert all(r.f.start is None and r.f.end is None for r in df.select(D.timeframe(F.col("q")).alias("f")).collect())
