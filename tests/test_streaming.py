import datetime as dt

from conftest import block, message

from sondage.streaming import ingest


def with_time(row, at):
    return (*row[:-1], at)


def test_stream_counts_first_deliveries(spark, messages, tmp_path):
    now = dt.datetime(2024, 1, 1)
    rows = [with_time(message(f"u{i}", ts=f"2024-01-01T0{i % 3}:30:00Z", role="assistant", blocks=[block("tool_use", name=" READ", id=str(i))]), now) for i in range(6)]
    messages(rows + rows[:3], extra=False).write.parquet(str(tmp_path / "in"))
    once = ingest.first_deliveries(ingest.read_records(spark, str(tmp_path / "in")))
    ingest.write_table(once, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    counts = ingest.calls_per_window(ingest.read_records(spark, str(tmp_path / "in")))
    run = counts.writeStream.outputMode("complete").format("memory").queryName("calls").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sum(r.calls for r in spark.table("calls").collect()) == 9
    assert {r.tool for r in spark.table("calls").collect()} == {"read"}
