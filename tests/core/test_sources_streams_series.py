import io
import json
import zipfile
from datetime import date, datetime, timedelta

import pyspark.sql.functions as F
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from folioscope.operators import islands
from folioscope.plans.archive import page_of
from folioscope.plans.series import bands, charts, why_no_line
from folioscope.sources import files as S
from folioscope.sources import logs
from folioscope.sources.store import Store
from folioscope.streaming import expiring, streams

SF = "/root/testdata/sf0.001"
LOG = StructType([StructField("seq", LongType()), StructField("key", StringType())])


def test_logs(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    (path / "a.json").write_text('{"seq": 1, "key": "a", "new": 5}\n\n{"seq": 2, "ke\n{"seq": 3}\n')
    log = logs.read_log(spark, str(path), LOG).cache()
    assert tuple(logs.lines_and_torn(log).first()) == (2, 1)
    assert [(r.seq, r.key) for r in logs.sound(log).orderBy("seq").collect()] == [(1, "a"), (3, None)]
    logs.append(spark.createDataFrame([(4, "d")], LOG), str(path))
    assert logs.sound(logs.read_log(spark, str(path), LOG)).count() == 3


def test_one_source(spark, tmp_path):
    path = str(tmp_path / "t")
    both = spark.createDataFrame([("a", 1), ("b", 2)], "source_id string, v int")
    logs.replace_table(both, path)
    logs.replace_table(spark.createDataFrame([("b", 3)], "source_id string, v int"), path)
    one = logs.one_source(spark, path, "b")
    assert [r.v for r in one.collect()] == [3] and logs.one_source(spark, path, "a").first().v == 1
    assert "PartitionFilters: [isnotnull(source_id" in one._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        logs.one_source(spark, path, "")


def test_inventory(spark, tmp_path):
    folder = tmp_path / "2031" / "2019 forms" / "x"
    folder.mkdir(parents=True)
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:r><w:t>First</w:t></w:r></w:p><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:document>')
    (folder / "a.docx").write_bytes(book.getvalue())
    (folder / "bad.docx").write_bytes(book.getvalue()[:40])
    (folder / "t.txt").write_bytes("Привет, это обычный текст".encode("cp1251"))
    (folder / "u.txt").write_text("plain\ntext\n" * 10)
    (folder / "c.pdf").write_bytes(b"%PDF-1.4 /Type /Pages /Type /Page /Type /Page %%EOF")
    (folder / "d.pdf").write_bytes(b"%PDF-1.4 cut")
    (folder / "Thumbs.db").write_bytes(b"x")
    files = S.list_files(spark, str(tmp_path))
    got = {r.name: r for r in S.inventory(files, this_year=2026).collect()}
    assert all(r.folder_year == 2019 for r in got.values())
    assert got["a.docx"].category == "word" and got["bad.docx"].error and got["c.pdf"].parts == 2 and got["d.pdf"].error == "damaged file"
    assert len(got) == 7 and got["Thumbs.db"].skipped and got["Thumbs.db"].sha256 is None and got["u.txt"].category == "text"
    assert S.office_text(files.where("name = 'a.docx'")).first().text == "First\nSecond"
    pages = S.text_file_pages(files.where("name like '%.txt'"), 30).collect()
    assert "Привет, это обычный текст" in {r.text for r in pages} and sum("plain" in r.text for r in pages) == 4
    assert S.http_body(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody") == 25 and S.http_body(b"%PDF") == 0
    routes = spark.createDataFrame([("a" * 99,), ("a" * 100,), ("�" * 100,), (None,)], "t string").select(S.route(F.col("t"))).collect()
    assert [r[0] for r in routes] == ["vision", "text", "vision", "vision"]


def run_stream(query, name, mode="append"):
    q = query.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return query.sparkSession.table(name)


@pytest.fixture
def events(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    folder = str(tmp_path / "events")
    rows.coalesce(1).write.parquet(folder)
    return rows, spark.readStream.schema(rows.schema).parquet(folder)


def test_stream_sessions_and_windows(spark, events):
    rows, stream = events
    got = {(r.user_id, r.begins) for r in run_stream(streams.sessions(stream, "ts", "2 hours", "user_id"), "sessions").collect()}
    batch = islands.sessions(rows, ["user_id"], "ts", "event_id", 7200).collect()
    closed = max(r.ends for r in batch) - timedelta(hours=3, seconds=1)
    want = {(r.user_id, r.begins) for r in batch if r.ends < closed}
    assert want and want <= got <= {(r.user_id, r.begins) for r in batch}
    wide = run_stream(streams.tumbling(stream, "ts", "1 day", "event_type", "value"), "tumbling").collect()
    days = rows.groupBy(F.to_date("ts").alias("d"), "event_type").count().collect()
    want = {(r.d, r.event_type): r["count"] for r in days}
    assert wide and all(want[r.begins.date(), r.event_type] == r.events for r in wide)
    hops = run_stream(streams.sliding(stream, "ts", "2 days", "1 day", "event_type"), "sliding")
    assert hops.count() >= len(wide)
    once = run_stream(streams.first_of_key(stream, ["event_id"], "ts"), "once")
    assert once.count() == rows.count()


def test_stream_latest(spark, events, tmp_path):
    rows, stream = events
    path = str(tmp_path / "state")
    keyed = stream.select("user_id", "event_id", "value")
    for _ in range(2):  # again from the checkpoint: nothing new
        q = keyed.writeStream.foreachBatch(streams.keep_latest(spark, path, ["user_id"], "event_id")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.user_id: r.event_id for r in Store(spark, path, ["user_id"], "event_id").read().collect()}
    assert got == {r.user_id: r.m for r in rows.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}


def test_stream_state(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("a", t0 + timedelta(seconds=s), False) for s in (0, 10, 59, 60, 130)] + [("b", t0, False)]
    folder = str(tmp_path / "r")
    spark.createDataFrame(rows, "who string, at timestamp, ok boolean").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("who string, at timestamp, ok boolean").parquet(folder)
    got = run_stream(expiring.throttled(stream, "who", "at"), "throttled").collect()
    assert sorted((r.who, (r.at - t0).seconds, r.repeats) for r in got) == [("a", 0, 0), ("a", 60, 2), ("a", 130, 0), ("b", 0, 0)]
    rows = [("a", t0 + timedelta(seconds=s), s == 12) for s in range(24)]
    folder = str(tmp_path / "w")
    spark.createDataFrame(rows, "who string, at timestamp, ok boolean").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("who string, at timestamp, ok boolean").parquet(folder)
    got = run_stream(expiring.waiting(stream, "who", "at", "ok"), "waiting").collect()
    assert sorted(((r.at - t0).seconds, r.minutes) for r in got) == [(4, 1), (9, 5), (17, 1), (22, 5)]


def test_burst(spark):
    t0 = datetime(2024, 1, 1, 0, 5)
    for n, unusual in ((59, False), (60, True)):
        rows = [(t0 + timedelta(seconds=600 * k / (n - 1)), True, None) for k in range(n)] + [(t0, False, 3)]
        r = islands.burst_of_log(spark.createDataFrame(rows, "at timestamp, allowed boolean, repeats int")).first()
        assert (r.calls, r.refusals, r.busiest, r.unusual) == (n, 4, n, unusual)


V = "observation_id long, document_id long, indicator_id string, material string, name string, value string, value_numeric double, unit string, reference string, date date, snippet string"


def v(i, number, unit="g/l", ref=None, day=date(2020, 1, 1), material="blood", name="protein", snippet=""):
    return (i, i, "t", material, name, str(number), number, unit, ref, day, snippet)


def test_charts(spark):
    rows = [
        v(1, 70.0, "г/л", "60-80"), v(2, 71.0, "g/L", day=date(2020, 2, 1)), v(3, 69.0, "г/л", day=None), v(4, None, None, day=date(2020, 3, 1)),
        v(5, 72.0, None, day=date(2020, 4, 1)), v(6, 5.0, "mmol/l", material="urine"), v(7, 71.0, "g/l", day=date(2021, 1, 1), snippet="was 71 on 20.02.2020"),
        v(8, 0.070, "g/l", "0,06-0,08", date(2020, 5, 1)), v(9, 70.5, "g/l", "60-80", date(2020, 6, 1)), v(10, 71.5, "g/l", "60-80", date(2020, 7, 1)),
    ]
    out = charts(spark.createDataFrame(rows, V)).collect()
    by = {r.observation_id: r for r in out}
    assert set(by) == {1, 2, 3, 4, 5, 6, 8, 9, 10} and by[2].retold == 1
    assert {by[k].series for k in (1, 2, 3, 5, 8)} == {"g/l"} and by[6].series == "mmol/l" and by[4].why == "not_a_number" and by[3].why == "undated"
    assert by[8].moved == -3 and by[8].number == pytest.approx(70.0)
    assert [r.observation_id for r in sorted((r for r in out if r.series == "g/l"), key=lambda r: r.place)] == [1, 2, 5, 8, 9, 10, 3]
    frame = charts(spark.createDataFrame(rows, V))
    b = {r.observation_id: r for r in bands(frame).collect()}
    assert b[2].from_day == pytest.approx(b[1].to_day) and 3 not in b
    assert {(r.series, r.why) for r in why_no_line(frame).collect()} == {("mmol/l", "single"), ("", "not_a_number")}


def test_conversion(spark):
    rows = [v(1, 90.0, "mg/dl", name="Glucose"), v(2, 5.2, "mmol/l", name="Glucose"), v(3, 4.0, "10^3/мкл", name="wbc"), v(4, 5.0, "10^9/л", name="wbc")]
    by = {r.observation_id: r for r in charts(spark.createDataFrame(rows, V)).collect()}
    assert by[1].scale == by[2].scale == "mmol/l" and by[1].number == pytest.approx(4.996, abs=0.01)
    assert by[3].scale == by[4].scale == "10^9/l" and by[3].number == pytest.approx(4.0)


def test_page(spark):
    page = page_of(spark.range(10), [F.col("id")], 4, 8)
    assert [r.id for r in page["rows"]] == [8, 9] and page["total"] == 10 and page["next_offset"] is None
    assert page_of(spark.range(10), [F.col("id")], 4)["next_offset"] == 4
    assert json.dumps(page["returned"]) == "2"


def test_state_expires(spark, tmp_path):
    """Batches by file: what a key held is gone once the watermark has passed its time."""
    t0, folder = datetime(2024, 1, 1), tmp_path / "in"
    folder.mkdir()
    batches = [[("a", 0), ("a", 5), ("b", 0)], [("c", 8000)], [("c", 9000)], [("a", 9010), ("b", 9020), (None, 9020)]]
    for k, batch in enumerate(batches):
        rows = [(w, t0 + timedelta(seconds=s)) for w, s in batch]
        spark.createDataFrame(rows, "who string, at timestamp").coalesce(1).write.parquet(str(folder / f"{k}.parquet"))
    stream = spark.readStream.schema("who string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    out = expiring.throttled(stream, "who", "at", quiet=60, keep=600, late="0 seconds")
    base = str(tmp_path / "out")
    query = out.writeStream.format("parquet").option("path", base).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(((r.at - t0).seconds, r.who, r.repeats) for r in spark.read.schema(out.schema).parquet(base).collect())
    assert [(s, w) for s, w, _ in got] == [(0, "a"), (0, "b"), (8000, "c"), (9000, "c"), (9010, "a"), (9020, "b")]
    assert all(repeats == 0 for *_, repeats in got)  # the one held back of "a" is forgotten with its state
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in map(json.loads, (p.json for p in query.recentProgress)) if p["stateOperators"]]
    assert rows[-1] <= 4 and max(rows) >= 3


def test_rows_of_a_sheet_that_are_left_out(spark, tmp_path):
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        rows = "".join(f"<row><c><v>{k}</v></c><c><v>{k * k}</v></c></row>" for k in range(7))
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{rows}</sheetData></worksheet>")
    (tmp_path / "s.xlsx").write_bytes(book.getvalue())
    files = S.list_files(spark, str(tmp_path))
    part = S.office_text(files, most_rows=5).first()
    assert part.text.split("\n")[-1] == "4\t16" and part.rows_left_out == 2 and S.office_text(files).first().rows_left_out == 0
