"""Every registered query of the DNS log against its SQL, at the smallest size."""

import duckdb
import pytest

from dnslens import queries as Q


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(sf):
    made = duckdb.connect()
    made.sql(f"create view events as select * from read_parquet('{sf}/events.parquet')")
    return made


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, sf, con, name):
    got = Q.QUERIES[name](spark, sf).toArrow()
    want = con.sql(Q.ORACLE_SQL[name])
    names = sorted(want.columns)
    assert sorted(got.column_names) == names
    at = [want.columns.index(c) for c in names]
    a = sorted((tuple(plain(r[c]) for c in names) for r in got.to_pylist()), key=repr)
    assert a == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_unanswered_stream_equals_the_batch(spark, sf):
    batch = {r.msg_id for r in Q.QUERIES["unanswered_queries"](spark, sf).where("rcode = 'TIMEOUT'").collect()}
    assert batch == {r.msg_id for r in Q.QUERIES["unanswered_stream"](spark, sf).collect()}


def test_streams_take_files_in_time_order(spark, sf, tmp_path):
    from dnslens import fixtures
    from dnslens.streaming import stateful

    log, path, seen = fixtures.dns_log(spark, sf), str(tmp_path / "log"), []
    stateful.in_time_order(log, path)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    reader = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    reader.foreachBatch(lambda df, k: seen.append(tuple(df.selectExpr("min(ts_ns)", "max(ts_ns)").first()))).start().awaitTermination()
    assert len(seen) == 6 and all(a[1] <= b[0] for a, b in zip(seen, seen[1:], strict=False))


def test_stream_files_hold_only_what_the_stream_reads(spark, sf):
    log = Q.X.dns_log(spark, sf)
    stream = Q._stream(log, ("identity", "length"))
    assert stream.columns == ["ts_ns", "msg_id", "identity", "length", "ts"]
    assert Q._stream(log).columns == [*log.columns, "ts"]


def test_sinks_write_compressed_files(spark, sf):
    for mode in ("text", "flat-json"):
        files = Q._written(mode)(Q.X.with_records(Q.X.dns_log(spark, sf))).inputFiles()
        assert files and all(f.endswith(".gz") for f in files)
