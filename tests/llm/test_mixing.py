"""Poisson mixing: determinism, rates, and the odd cases."""

from collections import Counter

from pyspark.sql import functions as F

from turnengine.llm import mixing


def test_odd_rows(make_docs, odd_rows):
    for extra in (False, True):
        docs = make_docs([*odd_rows, (9, "x", None), (10, "y", None)], extra)
        out = mixing.poisson_mix(docs)
        assert out.columns[: len(docs.columns)] == docs.columns and len(out.columns) == len(docs.columns) + 2
        if extra:
            assert {r["copy_no"] for r in out.collect()} <= {"clash"}
        rows = [tuple(r)[:5] for r in out.collect()]
        assert rows.count((6, "a b c d e f", "en", "s", 11)) % 2 == 0  # repeated rows draw alike
        assert set(rows) <= {tuple(r)[:5] for r in docs.collect()}
    assert mixing.poisson_mix(make_docs(odd_rows).limit(0)).count() == 0


def test_rates(make_docs):
    docs = make_docs([(i, "x" * 100, "big" if i < 3000 else "small") for i in range(4000)])
    rates = {r.mix_source: r.rate for r in mixing.source_rates(docs, {"big": 1.0, "small": 1.0}).collect()}
    assert abs(rates["big"] - 2 / 3) < 1e-9 and abs(rates["small"] - 2) < 1e-9
    got = Counter(r.source for r in mixing.poisson_mix(docs, {"big": 1.0, "small": 1.0}).collect())
    assert abs(got["big"] - 2000) < 200 and abs(got["small"] - 2000) < 200
    assert Counter(r.source for r in mixing.poisson_mix(docs, {"big": 1.0}).collect()).keys() == {"big"}
    twice = [sorted(map(tuple, mixing.poisson_mix(docs.repartition(n)).collect())) for n in (1, 7)]
    assert twice[0] == twice[1]


def test_large_rate_and_distribution(make_docs):
    docs = make_docs([(i, "x", "s") for i in range(3000)])
    n = mixing.poisson_mix(docs, budget=3000 * 40.0).groupBy("doc_id").count().agg(F.avg("count").alias("m"), F.variance("count").alias("v")).first()
    assert abs(n.m - 40) < 0.6 and abs(n.v - 40) < 4  # 40 is the sum of three draws


def test_order_is_mixed(make_docs):
    out = mixing.poisson_mix(make_docs([(i, "x", "ab"[i // 500]) for i in range(1000)]))
    keys = [[r.shuffle_key for r in part] for part in out.rdd.glom().collect()]
    assert all(k == sorted(k) for k in keys)


def test_rows_that_repeat_are_spread(spark, make_docs):
    docs = make_docs([(None, None)] * 4000 + [(1, "a b")])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = mixing.poisson_mix(docs, weights={"s": 1.0}, seed="mix-3")
        assert mixed.columns == [*docs.columns, "copy_no", "shuffle_key"]
        spread = [r["count"] for r in mixed.where("doc_id is null").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) == 4 and max(spread) < 0.4 * sum(spread)
