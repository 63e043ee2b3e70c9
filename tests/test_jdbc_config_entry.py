"""JDBC sink on embedded Derby (no port), job config, driver contract."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from clickwise.config import JobConfig
from clickwise.sinks.jdbc import jdbc_batch_writer
from tests.conftest import SF001, SF01


def test_jdbc_batch_writer_derby(spark, tmp):
    url = f"jdbc:derby:memory:clickwise{os.getpid()};create=true"
    props = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(0, "ad-1", "adv-1", None, "DESKTOP", 3, 2)],
                                 "window_start_ms long, ad_id string, advertiser_id string, country string, "
                                 "device_type string, click_count long, unique_sessions long")
    write = jdbc_batch_writer(url, "clicks_1min", props, versioned=True)
    write(rows, 7)
    write(rows.withColumn("click_count", F.lit(4).cast("long")), 8)
    back = spark.read.jdbc(url, "clicks_1min", properties=props)
    got = sorted((r.batch_id, r.click_count, r.country) for r in back.collect())
    assert got == [(7, 3, "UNKNOWN"), (8, 4, "UNKNOWN")]


def test_config_env_override_and_bad_int():
    cfg = JobConfig.load({"CLICKWISE_WINDOW_MINUTES": "5", "CLICKWISE_ALLOWED_LATENESS_SECONDS": "x",
                          "CLICKWISE_RAW_CLICKS_TOPIC": "clicks"})
    assert cfg.window_minutes == 5 and cfg.allowed_lateness_seconds == 30 and cfg.raw_clicks_topic == "clicks"
    assert JobConfig.load({}).window == "1 minutes" and JobConfig().watermark == "10 seconds"
    assert JobConfig().jdbc is None
    db = JobConfig.load({"CLICKWISE_JDBC_URL": "jdbc:x", "CLICKWISE_JDBC_USER": "u", "CLICKWISE_JDBC_PASSWORD": "secret"})
    assert db.jdbc == {"url": "jdbc:x", "table": "clicks_1min", "batch_size": 500, "properties": {"user": "u", "password": "secret"}}
    assert "secret" not in repr(db)


def test_entry_and_contract(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.mark.parametrize("name", sorted(entry_mod.oracle_sql()))
def test_query_matches_oracle_sf0001(spark, name):
    import duckdb
    from tools.oracle_check import digest, TABLES
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    sdf = entry_mod.queries()[name](spark, SF001)
    s_rows = [tuple(r) for r in sdf.collect()]
    res = con.execute(entry_mod.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(sdf.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert digest(sdf.columns, s_rows) == digest(d_cols, d_rows)


def test_shuffle_partitions_sized_from_input(spark):
    from clickwise.session import input_bytes, shuffle_partitions_for, size_shuffle_partitions
    assert input_bytes(spark, f"{SF001}/events.parquet") > 0
    before = spark.conf.get("spark.sql.shuffle.partitions")
    # an explicitly set value is kept
    assert size_shuffle_partitions(spark, SF001) == int(before)
    try:
        n = size_shuffle_partitions(spark, SF001, override=True)
        assert n == spark.sparkContext.defaultParallelism  # tiny input: the core count
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert shuffle_partitions_for(100 << 40, 4000) == 20_000  # 100 TB


def test_checkpoint_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace
    from clickwise.session import ensure_checkpoint_dir
    fake = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn"),
                           conf=SimpleNamespace(get=lambda k, d=None: None))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(fake)


# What the registered queries must exercise at sf0.01, from the oracle's side.
def _oracle_side(sql):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("events", "part", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return con.execute(sql).fetchone()


def test_green_rows_exercise_their_operators():
    o = entry_mod.oracle_sql()
    versions, = _oracle_side(f"SELECT max(n) FROM (SELECT count(*) AS n FROM ({o['minute_log']}) GROUP BY window_start_ms, ad_id, country, device_type)")
    assert versions == 3
    rows, kept = (_oracle_side(f"SELECT count(*) FROM ({o[q]})")[0] for q in ("event_projection", "dedup_vs_seen"))
    assert kept < rows
    twice, = _oracle_side(f"SELECT count(*) FROM (SELECT click_id FROM ({o['dedup_24h']}) GROUP BY click_id HAVING count(*) > 1)")
    assert twice > 0
    sessions, = _oracle_side(f"SELECT min(unique_sessions) FROM ({o['minute_agg_hll_check']})")
    assert sessions >= 200
    missing, = _oracle_side(f"SELECT count(*) FROM ({o['ad_dim_join']}) WHERE destination_url LIKE 'https://example.com%'")
    assert missing > 0
    latest, deltas, logged = (_oracle_side(f"SELECT sum(click_count) FROM ({o[q]})")[0] for q in ("hourly_rollup", "rollup_insert_sum", "minute_log"))
    assert logged > latest == deltas
