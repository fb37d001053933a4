"""Readers and writers on small files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from delaylens.session import materialize, scratch_path, shared_dir
from delaylens.sources import readers, sinks


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_flight_csv(spark, tmp_path):
    path = write(
        tmp_path / "f.csv",
        "fl_date,month,origin,arr_delay,cancelled,distance,extra\n"
        "2024-03-05,9,JFK,12.5,0,100.5,x\n"
        "never,9,LAX,abc,1,,y\n"
        "2024-12-31,9,,NaN,,7,z\n",
    )
    rows = readers.load_flights(spark, path).collect()
    assert [r.fl_date for r in rows] == [dt.date(2024, 3, 5), None, dt.date(2024, 12, 31)]
    assert [r.arr_delay for r in rows] == [12.5, None, None]
    assert [r.cancelled for r in rows] == [0, 1, None] and rows[0].extra == "x"
    assert [r.month for r in readers.load_flights_with_month(spark, path).collect()] == [3, None, 12]
    types = dict(readers.load_flights(spark, path).dtypes)
    assert (types["cancelled"], types["distance"], types["fl_date"]) == ("tinyint", "float", "date")


def test_travel_time_files(spark, tmp_path):
    text = "resultId,timeInSeconds,count,updated\nA,10.5,3,{}\n"
    paths = [
        write(tmp_path / "travel-time-2014.csv", text.format("2014-07-01 02:30:00+00:00")),
        write(tmp_path / "travel-time-2016.csv", text.format("2016-01-01T01:00:00-05:00")),
        write(tmp_path / "travel-time-2017.csv", text.format("bad")),
    ]
    rows = {r.year: r for r in readers.load_travel_time(spark, paths).collect()}
    assert rows[2014].updated_local == dt.datetime(2014, 6, 30, 22, 30)
    assert (rows[2014].hour, rows[2014].dow, rows[2014].month) == (22, "Monday", "2014-06")
    assert rows[2016].updated == dt.datetime(2016, 1, 1, 6, 0) and rows[2017].updated is None
    assert "hour" not in readers.load_travel_time(spark, paths, add_time_features=False).columns


def test_mode_file(spark, tmp_path):
    path = write(
        tmp_path / "subway.csv",
        "_id,Date,Time,Station,Code,Min Delay,Line\n"
        "1,2025-01-05,07:05,Finch Station,mu1,5,YU\n"
        "2,2025-01-05,25:00,Finch,mu1,5,YU\n"
        "3,2025-01-05,07:05,,mu1,5,YU\n"
        "4,2025-01-05,07:05,' ,mu1,5,YU\n"
        "5,2025-07-05,23:59,Eglinton and Yonge,,late,\n",
    )
    rows = readers.load_mode_file(spark, path, "subway").orderBy("_id").collect()
    assert [(r._id, r.station_key, r.min_delay, r.min_gap, r.mode) for r in rows] == [
        (1, "FINCH", 5.0, None, "subway"), (5, "EGLINTON", None, None, "subway"),
    ]
    assert rows[0].timestamp == dt.datetime(2025, 1, 5, 12, 5) and rows[1].timestamp == dt.datetime(2025, 7, 6, 3, 59)
    both = readers.union_feeds(readers.load_mode_file(spark, path, "bus"), readers.load_mode_file(spark, path, "subway").drop("line"))
    assert both.count() == 4


def test_codebook_files(spark, tmp_path):
    a = write(tmp_path / "a.csv", "CODE,DESCRIPTION\nx1,first\nx1,second\n")
    b = write(tmp_path / "b.csv", "CODE,DESCRIPTION\nX2,two\n,nobody\n")
    got = readers.load_codebook(spark, [a, str(tmp_path / "none.csv"), b]).collect()
    assert {r.code: r.description for r in got} == {"X1": "second", "X2": "two"}


def test_shared_folder_is_the_configured_one(spark):
    assert scratch_path(spark, "t").startswith(shared_dir(spark).rstrip("/"))
    df = materialize(spark.range(5).withColumn("x", F.lit(1)))
    assert df.count() == 5 and "RDD" in df._jdf.queryExecution().toString()


def test_incident_table(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2025, 1, 31, 23, 59)), (2, dt.datetime(2025, 2, 1))], "incident_id int, subway_timestamp timestamp_ntz")
    path = str(tmp_path / "incidents")
    sinks.write_incidents(df, path)
    back = sinks.read_incidents(spark, path)
    assert back.filter("incident_month = '2025-02'").count() == 1 and back.count() == 2


def test_metrics(spark, tmp_path):
    df = spark.createDataFrame([("m", "test", "auc", 0.75)], "model string, split string, metric string, value double")
    path = str(tmp_path / "metrics")
    sinks.write_metrics(df, path)
    assert sinks.read_metrics(spark, path).collect() == df.collect()
    with pytest.raises(Exception):
        sinks.read_metrics(spark, str(tmp_path / "none")).collect()


def test_short_offsets_and_dates_alone(spark, tmp_path):
    text = "resultId,timeInSeconds,count,updated\nA,1,1,2014-01-01 00:00:00-05\nB,1,1,2014-01-01 00:00:00.5+0530\nC,1,1,2014-01-01\nD,1,1,2014-01-01T10:00:00Z\n"
    path = write(tmp_path / "travel-time-2014.csv", text)
    got = {r.resultId: r.updated for r in readers.load_travel_time(spark, path).collect()}
    assert got == {
        "A": dt.datetime(2014, 1, 1, 5), "B": dt.datetime(2013, 12, 31, 18, 30, 0, 500000),
        "C": dt.datetime(2014, 1, 1), "D": dt.datetime(2014, 1, 1, 10),
    }


def test_headers_in_another_order(spark, tmp_path):
    (tmp_path / "both").mkdir()
    a = write(tmp_path / "both" / "a.csv", "origin,dest,month\nA,B,1\n")
    b = write(tmp_path / "both" / "b.csv", "dest,origin\nD,C\n")
    rows = readers.load_flights(spark, [a, b]).orderBy("origin").collect()
    assert [(r.origin, r.dest, r.month) for r in rows] == [("A", "B", 1), ("C", "D", None)]
    together = readers.load_flights(spark, str(tmp_path / "both")).orderBy("origin").collect()
    assert [(r.origin, r.dest, r.month) for r in together] == [("A", "B", 1), ("C", "D", None)]


def test_last_row_of_part_files_wins(spark, tmp_path):
    folder = tmp_path / "codes"
    folder.mkdir()
    write(folder / "part-0.csv", "CODE,DESCRIPTION\nx,first\n" + "y,filler\n" * 3000)
    write(folder / "part-1.csv", "CODE,DESCRIPTION\nX,second\n")
    got = {r.code: r.description for r in readers.load_codebook(spark, [str(folder)]).collect()}
    assert got["X"] == "second"


def _write(path, text):
    path.parent.mkdir(exist_ok=True, parents=True)
    path.write_text(text)


def test_files_of_one_folder_in_other_orders(spark, tmp_path):
    """Every CSV reader matches columns by name inside one path too."""
    roads = tmp_path / "my roads"
    _write(roads / "t-2020.csv", "resultId,timeInSeconds,count,updated\na,1.5,10,2020-01-01 00:00:00\n")
    _write(roads / "t-2021.csv", "resultId,count,timeInSeconds,updated\nb,20,2.5,2021-01-01 00:00:00\n")
    _write(roads / "t-2022.csv", "updated,resultId,timeInSeconds\n2022-01-01 00:00:00,c,x\n")
    _write(roads / "t-2023.csv", "")
    got = {r.resultId: (r.timeInSeconds, r["count"], r.year) for r in readers.load_travel_time(spark, str(roads)).collect()}
    assert got == {"a": (1.5, 10, 2020), "b": (2.5, 20, 2021), "c": (None, None, 2022)}

    flights = tmp_path / "flights"
    _write(flights / "a.csv", "origin,dest,arr_delay\nAAA,BBB,5\n")
    _write(flights / "b.csv", "arr_delay,dest,origin\n7,CCC,DDD\n")
    got = {(r.origin, r.dest, r.arr_delay) for r in readers.load_flights(spark, str(flights)).collect()}
    assert got == {("AAA", "BBB", 5.0), ("DDD", "CCC", 7.0)}

    modes = tmp_path / "modes"
    _write(modes / "a.csv", "Date,Time,Station,Code,Line,Min Delay\n2024-01-01,08:00,KING STATION,X,1,3\n")
    _write(modes / "b.csv", "Station,Min Delay,Line,Code,Time,Date,Min Gap\nQUEEN STATION,4,2,Y,09:00,2024-01-02,6\n")
    got = {(r.code, r.min_delay, r.min_gap, r.line) for r in readers.load_mode_file(spark, str(modes), "subway").collect()}
    assert got == {("X", 3.0, None, "1"), ("Y", 4.0, 6.0, "2")}

    books = tmp_path / "books"
    _write(books / "a.csv", "CODE,DESCRIPTION\nx,old\ny,why\n")
    _write(books / "b.csv", "DESCRIPTION,CODE\nnew,X\n")
    got = {(r.code, r.description) for r in readers.load_codebook(spark, [str(books)]).collect()}
    assert got == {("X", "new"), ("Y", "why")}


def test_header_groups_and_no_files(spark, tmp_path):
    _write(tmp_path / "a" / "1.csv", "x,y\n1,2\n")
    _write(tmp_path / "a" / "2.csv", "y,x\n1,2\n")
    _write(tmp_path / "a" / "3.csv", "x,y\n3,4\n")
    groups = readers.header_groups(spark, str(tmp_path / "a"))
    assert [(h, len(f)) for h, f in groups] == [(("x", "y"), 2), (("y", "x"), 1)]
    _write(tmp_path / "b" / "1.csv", "")
    assert readers.read_csv(spark, str(tmp_path / "b")).count() == 0
