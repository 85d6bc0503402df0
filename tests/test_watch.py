"""Events of a real stream, sinks that fail or are full, budgets of running work."""

import time

import pytest

from weftline.operators import contracts
from weftline.streaming import watch
from weftline.streaming.watch import Budget, BudgetExceeded


def test_a_streams_life_as_events(spark, tmp_path):
    source, waiting = str(tmp_path / "in"), watch.BoundedEvents()
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    dispatcher = watch.Dispatcher().on("*", waiting.put)
    listener = watch.StreamEvents(dispatcher, only={"watched"})
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        for name in ("watched", "other"):
            run = stream.writeStream.queryName(name).format("parquet").option("path", str(tmp_path / f"out-{name}")).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
            run.awaitTermination()
        found = []
        for _ in range(100):
            found += waiting.drain(spark).collect()
            if found and found[-1]["event_type"] == "workflow_completed":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert found[0]["event_type"] == "workflow_started" and len({r["run_id"] for r in found}) == 1
    assert sum(r["item_count"] for r in found if r["event_type"] == "stage_summary") == 30
    path = str(tmp_path / "events")
    assert watch.append_events(spark.createDataFrame([tuple(r) for r in found], watch.EVENT), path) == len(found)
    judged = contracts.events_judged(watch.read_events(spark, path))
    assert judged.count() == len(found) and judged.filter("not valid").count() == 0


def test_failing_and_full_sinks_are_counted(spark):
    waiting, seen = watch.BoundedEvents(2), []

    def breaks(made):
        raise OSError

    dispatcher = watch.Dispatcher(most_failures=1).on("workflow_started", breaks).on("*", waiting.put).on("stage_summary", seen.append)
    for _ in range(3):
        dispatcher.emit(watch.event("r", "workflow_started", contracts.WORKFLOW, "started"))
    assert dispatcher.failure_count == 3 and len(dispatcher.failures) == 1 and dispatcher.failures[0][2] == "OSError"
    assert waiting.dropped == 1 and waiting.drain(spark).count() == 2 and waiting.drain(spark).count() == 0 and seen == []
    with pytest.raises(ValueError):
        watch.BoundedEvents(0)


def slow(df):
    def work(batches):
        for pdf in batches:
            time.sleep(0.4)
            yield pdf

    return df.mapInPandas(work, df.schema)


def test_budgets_stop_running_work(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 6400, numPartitions=64).write.parquet(path)
    # One file a task, so that the work is in many waves.
    read = lambda: spark.read.parquet(path)
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        out = str(tmp_path / "out")
        with pytest.raises(BudgetExceeded) as e:
            watch.run_within(spark, lambda: slow(read()).write.parquet(out), Budget(max_total_records=500), every=0.05)
        assert e.value.which == "max_total_records" and 500 < e.value.records < 6400
        assert not (tmp_path / "out" / "_SUCCESS").exists()
        with pytest.raises(BudgetExceeded) as e:
            watch.run_within(spark, lambda: slow(read()).write.parquet(str(tmp_path / "o2")), Budget(wall_timeout_seconds=0.5), every=0.05)
        assert e.value.which == "wall_timeout_seconds"
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    assert watch.run_within(spark, lambda: read().groupBy().sum("id").first()[0], Budget(6400, 1 << 30, 60)) == sum(range(6400))
    # Ended before anyone looked, and over its budget all the same.
    with pytest.raises(BudgetExceeded):
        watch.run_within(spark, lambda: read().groupBy().sum("id").first()[0], Budget(6399), every=60)
    with pytest.raises(ZeroDivisionError):
        watch.run_within(spark, lambda: 1 // 0, Budget(1))
    with pytest.raises(ValueError):
        Budget(max_total_bytes=0)
