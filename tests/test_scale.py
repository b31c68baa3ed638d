"""What only shows on many rows or on a cluster: numbering, shipping."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from turnengine import shipping
from turnengine.functions.ordinal import with_ordinal
from turnengine.functions import sequence
from turnengine.operators import build, quality, translate


@pytest.mark.parametrize("rows", [5_000_000, 0, 1])
def test_numbers_have_no_gap_and_no_repeat(spark, rows):
    # more rows than the sample of a range exchange holds, in partitions of unequal size, with ties
    df = spark.range(0, rows, 1, 13).select((F.col("id") * 2_654_435_761 % 1_000_003).alias("k"), "id", F.lit("x" * 20).alias("wide"))
    told = with_ordinal(df, ["k"], "n")
    out = told.agg(F.count("*").alias("rows"), F.count_distinct("n").alias("numbers"), F.min("n").alias("low"), F.max("n").alias("high")).first()
    assert tuple(out) == ((rows, rows, 1, rows) if rows else (0, 0, None, None))
    if rows > 1:  # the numbers follow the order
        steps = told.groupBy(F.floor(F.col("n") / 1000).alias("b")).agg(F.min("k").alias("a"), F.max("k").alias("z"))
        both = steps.alias("l").join(steps.alias("r"), F.col("l.b") + 1 == F.col("r.b"))
        assert both.where("l.z > r.a").isEmpty()


def test_row_numbers_of_large_workbooks(spark):
    n = 1_500_000
    rows = spark.range(n).select(
        F.lit("C").alias("conversazione"), F.when(F.col("id") % 100_000 == 7, "bad").otherwise((F.col("id") + 1).cast("string")).alias("turn_index"), F.lit("t").alias("napoletano"), F.col("id").alias("pos"), F.lit("y" * 30).alias("italiano"),
    )
    found = [r.data_row for r in quality.structural(rows).where("check = 'bad_turn_index'").orderBy("data_row").collect()]
    assert found == [i + 2 for i in range(7, n, 100_000)]


def test_every_conversation_is_numbered(spark):
    codes = spark.range(300_000).select(F.format_string("%09d", F.col("id") * 7919 % 300_000).alias("code"))
    asked, unknown = build.select_conversations(codes, everything=True)
    assert unknown.isEmpty() and asked.where(F.col("code").cast("int") + 1 != F.col("conv_ord")).isEmpty() and asked.count() == 300_000


@pytest.mark.parametrize(("master", "ships"), [("local[4]", False), ("local", False), ("local-cluster[2,1,1024]", True), ("spark://host:7077", True), ("yarn", True), ("k8s://https://host", True)])
def test_executors_elsewhere_always_get_the_package(monkeypatch, master, ships):
    root = shipping.Path(shipping.__file__).resolve().parents[1]
    monkeypatch.setenv("PYTHONPATH", str(root))
    monkeypatch.chdir(root)
    sent = []
    context = SimpleNamespace(master=master, applicationId=f"app-{master}", addPyFile=sent.append)
    shipping.ship(SimpleNamespace(sparkContext=context))
    assert bool(sent) == ships
    shipping.ship(SimpleNamespace(sparkContext=context))
    assert len(sent) == ships  # once per application
    if ships:
        import zipfile

        assert "turnengine/functions/ordinal.py" in zipfile.ZipFile(sent[0]).namelist()


def test_a_hot_conversation_is_spread_over_tasks(spark, monkeypatch):
    n = 1_000_000
    turns = spark.range(n + 300).select(
        F.when(F.col("id") < n, "hot").when(F.col("id") % 3 > 0, F.concat(F.lit("c"), F.col("id") % 7)).alias("conversazione"), (F.col("id") * 7_919 % 1_000_003).alias("turn_ord"), F.lit("A").alias("speaker"), F.col("id").cast("string").alias("italiano"), F.lit("").alias("napoletano"),
    )
    for key, value in (("spark.sql.shuffle.partitions", 16), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(key, value)
    try:
        told = translate.context_window(turns)
        tasks = told.where("conversazione = 'hot'").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum(F.size("context")).alias("shown")).collect()
        assert len(tasks) >= 8 and max(r["n"] for r in tasks) < n / 3 and sum(r["shown"] for r in tasks) == 4 * n - 10
        digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("conversazione", "turn_ord", F.to_json("context")).cast("decimal(38,0)"))).first()
        spread = digest(told)
        numbers = sequence.number_within(turns, "conversazione", ["turn_ord"], "i", sequence.hot_groups(turns, "conversazione"))
        parts = numbers.where("conversazione = 'hot'").groupBy(F.spark_partition_id()).agg(F.sum("i")).count()
        placed = numbers.agg(F.sum(F.xxhash64("conversazione", "turn_ord", "i").cast("decimal(38,0)"))).first()
        monkeypatch.setattr(sequence, "HOT", 1 << 40)
        assert digest(translate.context_window(turns)) == spread and spread[0] == n + 300
        plain = sequence.number_within(turns, "conversazione", ["turn_ord"], "i", None)
        assert plain.agg(F.sum(F.xxhash64("conversazione", "turn_ord", "i").cast("decimal(38,0)"))).first() == placed and parts >= 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_hot_limits_give_the_same_turns(spark, monkeypatch):
    tokens = spark.range(900).select(F.concat(F.lit("c"), F.col("id") % 4).alias("conversazione"), F.col("id").alias("pos"), F.lit("S").alias("speaker"), (F.col("id") * 37 % 300).cast("string").alias("tu"), F.concat(F.lit("w"), "id").alias("form"), F.lit("linguistic").alias("type"), F.lit("none").alias("variation"), F.lit("_").alias("feats"))
    meta = spark.createDataFrame([("c1", "r", "m", "l")], "code string, regione string, macro_regione string, languages string")
    plain = sorted(map(tuple, build.build_turns(tokens, meta).collect()))
    monkeypatch.setattr(sequence, "HOT", 200)
    monkeypatch.setattr(sequence, "BLOCK", 7)
    assert sorted(map(tuple, build.build_turns(tokens, meta).collect())) == plain
    turns = build.build_turns(tokens, meta).withColumn("turn_ord", F.col("turn_index"))
    spread = sorted(str(r) for r in translate.context_window(turns).collect())
    monkeypatch.setattr(sequence, "HOT", 1 << 40)
    assert sorted(str(r) for r in translate.context_window(turns).collect()) == spread
