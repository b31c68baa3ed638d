"""Waves, saves by bucket, and the keyed stream, against translating turn by turn."""

import random

import pytest
from pyspark.sql import functions as F

from turnengine.operators import translate
from turnengine.plans import exchange
from turnengine.sinks.buckets import BucketStore
from turnengine.streaming.translate import translate_turns

TURN = "conversazione string, turn_index int, turn_ord int, italiano string, napoletano string"


def make_backend():
    def answer(messages):  # made here, so that it travels to workers by value
        text = messages[1]["content"]
        own = text.split("Translate:\n")[-1]
        if own.endswith("!"):
            raise OSError("refused")
        return f"{len(text)}-{own}"

    return answer


backend = make_backend()


def turn_by_turn(rows, limit):
    """rows by conversation and turn, translated in that order until limit are."""
    done, by, made = [], {}, 0
    for c, _, o, text, nap in sorted(rows, key=lambda r: (r[0], r[2])):
        before = by.setdefault(c, [])
        if nap == "" and (limit is None or made < limit):
            try:
                nap = backend([{}, {"content": translate.prompt(before[-4:], text)}])
                made += 1
            except OSError:
                pass
        before.append((text, nap))
        done.append((c, o, nap))
    return done, made


def corpus(seed, conversations=9):
    rng = random.Random(seed)
    return [(f"c{c}", i + 1, i, f"t{c}.{i}" + "!" * (rng.random() < 0.25), "known" if rng.random() < 0.3 else "") for c in range(conversations) for i in range(rng.randint(0, 14))]


@pytest.mark.parametrize(("limit", "per"), [(None, 3), (1, 10), (17, 2), (40, 5), (1000, 100)])
def test_waves_equal_turn_by_turn(spark, tmp_path, limit, per):
    rows = corpus(limit or 5)
    store = BucketStore(spark, str(tmp_path / "s"), buckets=5)
    made = translate.translate_in_waves(spark.createDataFrame(rows, TURN), store, per, limit, backend=backend)
    expected, n = turn_by_turn(rows, limit)
    assert made == n and [(r.conversazione, r.turn_ord, r.napoletano) for r in store.read().orderBy("conversazione", "turn_ord").collect()] == expected


def test_a_wave_works_on_every_conversation_that_the_limit_reaches(spark):
    rows = spark.createDataFrame([(f"c{c}", i, i, "x", "") for c in range(20) for i in range(10)], TURN).withColumn("failed", F.lit(False))
    tried = lambda **how: {r[0]: r[1] for r in translate.translate_wave(rows, backend, **how).groupBy("conversazione").count().collect()}
    assert tried(per=3) == {f"c{c}": 3 for c in range(20)}  # at least as many as cores
    first = sorted(f"c{c}" for c in range(20))
    assert tried(per=3, remaining=95) == {c: 3 for c in first[:10]} and tried(remaining=95) == {c: 10 for c in first[:9]} | {first[9]: 5}


def test_tasks_get_turns_with_their_context_alone(spark):
    rows = spark.createDataFrame([("a", i, i, f"t{i}", "" if i in (500, 504, 900) else "k") for i in range(1000)], TURN).withColumn("failed", F.lit(False))
    got = {r.turn_ord: r.napoletano for r in translate.translate_wave(rows, lambda m: m[1]["content"], context=4).collect()}
    assert sorted(got) == [500, 504, 900] and "- t500  ->  Context:" in got[504] and got[900].startswith("Context:\n- t896  ->  k\n- t897")


def versions(store):
    return store._manifest(store._versions()[-1])["versions"]


def test_a_save_rewrites_one_bucket_and_survives_a_stop(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"c{c}", i, i, "x", "") for c in range(40) for i in range(3)], TURN)
    store = BucketStore(spark, str(tmp_path / "s"), buckets=8)
    store.create(rows)
    before = versions(store)
    change = lambda nap: spark.createDataFrame([("c7", 1, nap)], "conversazione string, turn_ord int, napoletano string")
    touched = store.update(change("one"), ["conversazione", "turn_ord"])
    after = versions(store)
    assert len(touched) == 1 and [b for b in after if after[b] != before.get(b)] == [str(touched[0])] and len(before) == 8
    read = lambda s: s.read().where("napoletano <> ''").select("conversazione", "turn_ord", "napoletano").collect()
    assert list(map(tuple, read(store))) == [("c7", 1, "one")] and store.read().count() == 120

    def stop(self, version, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # between writing the bucket and swapping the manifest
        m.setattr(BucketStore, "_swap", stop)
        with pytest.raises(KeyboardInterrupt):
            store.update(change("lost"), ["conversazione", "turn_ord"])
    again = BucketStore(spark, str(tmp_path / "s"))
    assert list(map(tuple, read(again))) == [("c7", 1, "one")] and again.read().count() == 120
    for n in range(4):
        again.update(change(f"n{n}"), ["conversazione", "turn_ord"])
    assert list(map(tuple, read(again))) == [("c7", 1, "n3")] and len(list((tmp_path / "s").glob("manifest*"))) == 2 and len(list((tmp_path / "s").glob("v*"))) <= 3
    again.remove()
    assert not again.exists()


def test_later_batches_see_their_context(spark, tmp_path):
    rows = corpus(3, 6)
    for k, part in enumerate(([r for r in rows if r[2] < 2], [r for r in rows if r[2] in (2, 5, 3, 4)], [r for r in rows if r[2] > 2])):  # the last repeats some
        spark.createDataFrame(part, TURN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(TURN).parquet(str(tmp_path / "in"))
        query = translate_turns(stream, str(tmp_path / "out"), str(tmp_path / "cp"), backend)
        query.awaitTermination()
        assert query.exception() is None and k >= 0
    expected, n = turn_by_turn(rows, None)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert [(r.conversazione, r.turn_ord, r.napoletano) for r in found.orderBy("conversazione", "turn_ord").collect()] == expected
    assert found.where("fresh").count() == n and found.where("failed").count() == sum(r[4] == "" for r in rows) - n


def test_deliveries_of_the_stream_are_dealt(spark, tmp_path, monkeypatch):
    """No task writes a delivery whole, and each is one micro-batch all the same."""
    monkeypatch.setattr(exchange, "shared_dir", lambda _: str(tmp_path))
    rows = corpus(4, 9)
    found = exchange.translated_stream(spark, spark.createDataFrame(rows, TURN.replace("turn_ord int", "turn_ord long")).repartition(3, "turn_index"), "P")
    assert found.count() == len(rows) and found.where("fresh").count() == sum(r[4] == "" for r in rows)
    (path,) = tmp_path.iterdir()
    assert len(list(path.glob("in/*.parquet"))) > 4 and len([f for f in (path / "checkpoint" / "offsets").iterdir() if f.name.isdigit()]) == 4
