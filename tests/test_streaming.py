"""Streams over small directories, drained to the end."""

from pyspark.sql import functions as F

from lumispan.schema import DAY_US, ModelConfig
from lumispan.sources.tables import events_as_spans
from lumispan.streaming import traces as st

SF = "/root/testdata/sf0.001"


def files(spark, tmp_path, n=2):
    path = str(tmp_path / "spans")
    events_as_spans(spark, SF).drop("attrs").where("trace_id like '1-%' or trace_id like '2-%'").repartition(n, "trace_id").write.parquet(path)
    return path


def test_rates_equal_batch(spark, tmp_path):
    path = files(spark, tmp_path)
    q = st.rates(st.once(st.span_stream(spark, path), "60 days"), "1 day").writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["service"], r["n"]) for r in spark.sql("select service, sum(n) n from rates group by service").collect()}
    want = {(r["service"], r["n"]) for r in spark.read.parquet(path).groupBy("service").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_train_and_regenerate(spark, tmp_path):
    path, config, seen = files(spark, tmp_path), ModelConfig(bucket_us=DAY_US), []
    q = st.train_batches(st.span_stream(spark, path), str(tmp_path / "models"), str(tmp_path / "c1"), config)
    q.awaitTermination(120)
    assert q.exception() is None
    r = st.regenerate_batches(spark, str(tmp_path / "models"), str(tmp_path / "c2"), config, lambda df, name: seen.append((name, df.where("depth = 0").count())))
    r.awaitTermination(120)
    assert r.exception() is None
    roots = spark.read.parquet(path).where("parent_span_id is null").count()
    assert seen and seen[0] == ("batch=0", roots)


def test_running_cusum_matches_batch(spark, tmp_path):
    from lumispan.operators.diagnosis import cusum

    values = [1.0, 1.1, 0.9, 1.0, 1.05, 0.95, 1.0, 1.1, 0.9, 1.0, 1.0, 1.0, 2.0, 2.0]
    rows = spark.createDataFrame([("a", "mean", i, v) for i, v in enumerate(values)], "service string, signal string, time bigint, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))
    q = st.running_cusum(stream).writeStream.format("memory").queryName("cusum").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [r["time"] for r in spark.sql("select * from cusum where alarm").collect()]
    assert got == [r["time"] for r in cusum(rows).where("alarm").collect()]


def test_assembled_traces_are_whole(spark, tmp_path):
    path = files(spark, tmp_path, 1)
    late = spark.read.parquet(path).limit(1).withColumn("start_us", F.lit(4_000_000_000_000_000)).withColumn("trace_id", F.lit("zz"))
    late.write.mode("append").parquet(path)  # moves the watermark past all others
    q = st.assembled(st.span_stream(spark, path, st.BufferConfig(max_files_per_flush=1))).writeStream.format("memory").queryName("whole").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["trace_id"], r["n"]) for r in spark.sql("select trace_id, count(distinct span_id) n from whole group by trace_id").collect()}
    want = {(r["trace_id"], r["n"]) for r in spark.read.parquet(path).where("trace_id <> 'zz'").groupBy("trace_id").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_a_full_buffer_makes_several_models(spark, tmp_path):
    path, config = files(spark, tmp_path, 1), ModelConfig(bucket_us=DAY_US)
    traces = spark.read.parquet(path).select("trace_id").distinct().count()
    q = st.train_batches(st.span_stream(spark, path), str(tmp_path / "m"), str(tmp_path / "c"), config, buffer=st.BufferConfig(max_traces_per_model=-(-traces // 2)))
    q.awaitTermination(120)
    assert q.exception() is None
    names = sorted(p.name for p in (tmp_path / "m").iterdir())
    assert names == ["batch=0-0", "batch=0-1"]
    n = sum(spark.read.parquet(str(tmp_path / "m" / x / "bucket_meta")).agg(F.sum("traces").alias("n")).first()["n"] for x in names)
    assert n == traces


def test_running_sifter_equals_one_fold(spark, tmp_path):
    import numpy as np

    from lumispan.operators.samplers import PathModel, keep_probability

    rng = np.random.default_rng(4)
    rows = [("a", f"t{i:03}", i, [[int(x) for x in rng.integers(0, 6, 5)] for _ in range(i % 3)], float(rng.random())) for i in range(120)]
    df = spark.createDataFrame(rows, "stream string, trace_id string, start_us bigint, paths array<array<int>>, draw double")
    for i in range(2):
        df.where(F.col("start_us").between(60 * i, 60 * i + 59)).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    q = st.running_sifter(stream, 6, 4).writeStream.format("memory").queryName("sifted").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    model, recent, want = PathModel(6), [], {}
    for _, name, _, paths, draw in rows:
        each = [model.learn(p) for p in paths]
        loss = float(np.mean(each)) if each else 0.0
        want[name] = (round(loss, 9), draw < keep_probability(recent, loss, 4, 50))
        recent = [*recent, loss][-50:]
    got = {r["trace_id"]: (round(r["loss"], 9), r["kept"]) for r in spark.sql("select * from sifted").collect()}
    assert got == want


def drained(query, name):
    query.processAllAvailable()
    query.stop()
    return name


def test_feed_hands_on_each_model_once_and_counts_what_it_drops(spark, tmp_path):
    from lumispan.sources.feed import ModelFeed

    def finish(*names):
        for n in names:
            (tmp_path / "models" / n / "done").mkdir(parents=True)
            (tmp_path / "models" / n / "done" / "_SUCCESS").touch()

    spark.dataSource.register(ModelFeed)
    seen = []

    def run():
        feed = spark.readStream.format("model_feed").option("path", str(tmp_path / "models")).option("queue", 3).load()
        q = feed.writeStream.foreachBatch(lambda b, _: seen.extend(sorted((r["name"], r["dropped"]) for r in b.collect()))).option("checkpointLocation", str(tmp_path / "c"))
        drained(q.start(), "")

    finish("batch=0", "batch=1")
    (tmp_path / "models" / "batch=2").mkdir()  # not finished
    run()
    assert seen == [("batch=0", 0), ("batch=1", 0)]
    finish("batch=3", "batch=4", "batch=5", "batch=6", "batch=7")
    run()
    run()
    assert seen[2:] == [("batch=5", 2), ("batch=6", 0), ("batch=7", 0)]


def test_feed_waits_longer_after_each_failure(monkeypatch):
    from lumispan.sources import feed

    pauses, left = [], [OSError(), OSError(), OSError()]

    def listed(path, marker):
        if left:
            raise left.pop()
        return ["a", "b"]

    monkeypatch.setattr(feed, "listed", listed)
    monkeypatch.setattr(feed.time, "sleep", pauses.append)
    reader = feed.FeedReader("/x", 4, "done")
    assert reader.latestOffset() == {"upto": "b"} and pauses == [1.0, 2.0, 4.0]
    left += [OSError()] * feed.ATTEMPTS
    assert reader.latestOffset() == {"upto": "b"} and len(pauses) == 3 + feed.ATTEMPTS - 1 and max(pauses) <= 30.0


def test_buffer_flushes_when_full_and_when_quiet(spark, tmp_path):
    from lumispan.streaming import buffer

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", buffer.ROCKS)
    columns = "trace_id string, span_id string, parent_span_id string, service string, operation string, kind string, status string, start_us bigint, dur_us bigint"
    row = lambda t, s, d=1: (t, s, None, "a", "o", "", "0", 1, d)
    files = [[row("t1", "x"), row("t1", "x", 9), row("t1", "y"), row("t2", "x")], [row("t3", "x"), row("t4", "x"), row("t1", "late")]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    flushed = buffer.buffered(stream, st.BufferConfig(max_traces_per_model=3, flush_seconds=2))
    q = flushed.writeStream.format("memory").queryName("flushes").outputMode("append").trigger(processingTime="500 milliseconds").start()
    import time

    for _ in range(60):
        time.sleep(1)
        rows = spark.sql("select * from flushes").collect()
        if len(rows) >= 6:
            break
    q.stop()
    by_flush = {}
    for r in rows:
        by_flush.setdefault(r["flush"], set()).add((r["trace_id"], r["span_id"], r["dur_us"]))
    assert by_flush[0] == {("t1", "x", 9), ("t1", "y", 1), ("t2", "x", 1), ("t3", "x", 1)}  # full at the third trace
    assert by_flush[1] == {("t4", "x", 1), ("t1", "late", 1)}  # a new partial trace, flushed by the timer
