"""Bars in files: one a symbol, and tables in buckets of symbols."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import features
from tidemark.plans.queries import windowed
from tidemark.sources import io

DAYS = [dt.date(2021, 1, 4) + dt.timedelta(days=i) for i in range(60)]


def bars(spark, symbols=5):
    rows = [(f"s{k}", d, 1.0 * k + 1, 2.0 * k + 2, 0.5, 1.0 + k + i % 7, 100.0) for k in range(symbols) for i, d in enumerate(DAYS)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_bars_need_no_exchange(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    df = bars(spark)
    io.write_bar_table(df, path, 4)
    stored = io.read_bar_table(spark, path)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, df.collect()))
    wide = windowed(stored)
    assert "Exchange" not in plan(wide) and "Exchange" in plan(windowed(df))
    assert sorted(map(str, wide.collect())) == sorted(map(str, windowed(df).collect()))
    other = f"file://{tmp_path}/more"
    io.write_bar_table(df.withColumn("close", F.col("close") * 2), other, 4)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    both = stored.alias("a").join(io.read_bar_table(spark, other).alias("b").hint("merge"), ["symbol", "date"]).select("symbol", (F.col("b.close") / F.col("a.close")).alias("r"))
    assert "Exchange" not in plan(both) and {r["r"] for r in both.collect()} == {2.0}
    spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    assert "Exchange" not in plan(stored.groupBy("symbol").agg(F.max("close")))


def test_a_table_is_read_by_another_session(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    io.write_bar_table(bars(spark, 2), path, 3)
    other = spark.newSession()
    assert io.read_bar_table(other, path).count() == 120 and "Exchange" not in plan(io.read_bar_table(other, path).select("symbol", features.returns(1).alias("r")))


def test_files_of_unlike_columns(spark, tmp_path):
    """One file a symbol: columns in another order and case, with more of them, or without one."""
    base = pd.DataFrame({"Date": DAYS[:3], "Open": [1.0, 2.0, 3.0], "High": [2.0, 3.0, 4.0], "Low": [0.5, 1.0, 2.0], "Close": [1.5, float("nan"), 3.5], "Volume": [10.0, 20.0, 30.0]})
    (tmp_path / "bars").mkdir()
    base.to_parquet(tmp_path / "bars" / "AAA.parquet", index=False)
    base[["Volume", "Close", "Low", "High", "Open", "Date"]].assign(**{"Adj Close": 9.0}).to_parquet(tmp_path / "bars" / "B.B.parquet", index=False)
    base.drop(columns=["Volume"]).to_parquet(tmp_path / "bars" / "C-C.parquet", index=False)
    got = {(r["symbol"], r["date"]): r for r in io.read_bars(spark, f"file://{tmp_path}/bars/*.parquet").collect()}
    assert {s for s, _ in got} == {"AAA", "B.B", "C-C"} and len(got) == 9
    assert all(got[s, DAYS[0]]["open"] == 1.0 and got[s, DAYS[2]]["close"] == 3.5 and got[s, DAYS[1]]["close"] is None for s in ("AAA", "B.B", "C-C"))
    assert got["C-C", DAYS[0]]["volume"] is None and got["B.B", DAYS[0]]["volume"] == 10.0


def test_written_bars_are_read_without_opening_them_first(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    rows = [(s, dt.date(2021, 1, 4), 1.0, 2.0, 0.5, 1.5, 10.0) for s in ("007", "A")]
    io.write_bars(spark.createDataFrame(rows, io.WRITTEN), path)
    assert sorted(r["symbol"] for r in io.read_bars(spark, path, io.WRITTEN).collect()) == ["007", "A"]
