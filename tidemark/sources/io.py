"""Reading and writing the domain's files."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

C = F.col
UNIVERSE = "ticker string, name string, asset_class string, sector string, notes string"
BARS = ["open", "high", "low", "close", "volume"]
TRADES = "date string, ticker string, action string, price double, shares double, capital double, commission double, kelly_fraction double, agent_votes map<string,double>, reason string"
_METRICS = "struct<total_return:double,sharpe:double,max_drawdown:double,calmar:double>"
_RESULT = f"struct<metrics:{_METRICS},window_results:array<struct<iteration:int,val_start:string,val_end:string,total_return:double,sharpe:double,max_drawdown:double,n_tickers:int>>>"


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """The universe with `symbol` and its rank in the file (a dimension of some thousands of rows, read in one task)."""
    rows = spark.read.schema(UNIVERSE).csv(path, header=True).coalesce(1)
    return rows.withColumn("symbol_rank", F.monotonically_increasing_id()).withColumnRenamed("ticker", "symbol")


#: Columns of files that `write_bars` wrote.
WRITTEN = "symbol string, date date, " + ", ".join(f"{c} double" for c in BARS)


def read_bars(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Bars from one Parquet file per symbol, named after it, or from folders symbol=...; names of columns in any case. Files may differ in further columns and in the order of all.

    With a schema (`WRITTEN` for what `write_bars` wrote) no file is opened to learn its columns, and symbols stay as they are spelled.
    """
    df = spark.read.schema(schema).parquet(path) if schema else spark.read.option("mergeSchema", True).parquet(path)
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.regexp_extract(F.input_file_name(), r"([^/]+)\.parquet$", 1))
    df = df.select(*[C(c).alias(c.lower()) for c in df.columns])
    return df.select("symbol", C("date").cast("date"), *[F.nanvl(C(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in BARS])


def write_bars(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Only the bar columns, one folder per symbol; rows of a symbol are brought together first, so folders hold few files."""
    df.select("symbol", "date", *BARS).repartition("symbol").write.mode(mode).partitionBy("symbol").parquet(path)


#: Buckets of a stored bar table, by default.
BUCKETS = 64
_LAYOUT = "_layout"


def write_bar_table(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The bars as a table in `buckets` hash buckets of symbols, each sorted by symbol and date; the number is kept beside them.

    Rows are brought together once, when they are written; windows, aggregates and joins by symbol over the table then need no exchange. A folder that
    exists is not written over.
    """
    spark = df.sparkSession
    name = f"bars_{uuid.uuid4().hex}"
    rows = df.select(C("symbol").cast("string").alias("symbol"), "date", *BARS).repartition(buckets, "symbol")
    rows.write.bucketBy(buckets, "symbol").sortBy("symbol", "date").option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay where they are
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{path}/{_LAYOUT}")


def read_bar_table(spark: SparkSession, path: str) -> DataFrame:
    """The bars of `write_bar_table`, by any session, with what is known of how they lie.

    Joins of two such tables by symbol need no exchange; those by symbol and date neither, if spark.sql.requireAllClusterKeysForCoPartition is false.
    """
    buckets = spark.read.schema("buckets int").json(f"{path}/{_LAYOUT}").first()["buckets"]
    name = f"bars_{uuid.uuid4().hex}"
    columns = ", ".join(f"{c} DOUBLE" for c in BARS)
    spark.sql(f"CREATE TABLE {name} (symbol STRING, date DATE, {columns}) USING parquet CLUSTERED BY (symbol) SORTED BY (symbol, date) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`base` with the rows of `delta`; of rows with equal keys the last one stays, delta's after base's, then by all columns."""
    both = base.withColumn("_seq", F.lit(0)).unionByName(delta.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    rest = [C(c).desc_nulls_last() for c in base.columns if c not in keys]
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_seq"), *rest))).filter("_r = 1").drop("_r", "_seq")


def write_trade_log(df: DataFrame, path: str, mode: str = "append") -> None:
    df.withColumn("date", F.substring(C("date").cast("string"), 1, 10)).write.mode(mode).json(path)


def read_trade_log(spark: SparkSession, path: str, schema: str = TRADES) -> DataFrame:
    """Rows of a JSON-lines log; lines that aren't JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_log_with_errors(spark: SparkSession, path: str, schema: str = TRADES) -> DataFrame:
    """All lines, with the text of bad ones in `_corrupt_record`."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def read_experiments(spark: SparkSession, path: str, strategy: str = "strategy") -> DataFrame:
    """One row per result file with its metrics, number of windows and file name; `strategy` is the key of the strategy's own results."""
    schema = f"timestamp string, experiment string, `{strategy}` {_RESULT}, buy_and_hold {_METRICS}, sma_crossover {_METRICS}"
    df = spark.read.schema(schema).option("multiLine", True).json(path).withColumnRenamed(strategy, "_own")
    return df.select("timestamp", "experiment", "_own.metrics.*", F.coalesce(F.size("_own.window_results"), F.lit(0)).alias("n_windows"), "_own.window_results", C("buy_and_hold.sharpe").alias("buy_and_hold_sharpe"), C("sma_crossover.sharpe").alias("sma_sharpe"), F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"))


def read_equity_csv(spark: SparkSession, path: str) -> DataFrame:
    """A curve whose date column is named Date or date."""
    df = spark.read.csv(path, header=True)
    df = df.select(*[C(c).alias("date" if c.lower() == "date" else c) for c in df.columns])
    return df.select(C("date").cast("date"), *[C(c).try_cast("double").alias(c) for c in df.columns if c != "date"])


def write_equity_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def landed(df: DataFrame, name: str) -> DataFrame:
    """`df` written once below the shared folder and read back, so that what follows doesn't compute it again."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Free what no frame refers to any more: Spark drops the files of old shuffles only when the driver collects its memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of `work_dir` whose rows have been written anew elsewhere."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fixed(df: DataFrame) -> DataFrame:
    """`df` checkpointed in the shared folder: its rows stay in the tasks they are in, whatever is computed from them."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_dir(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; below a local one only where none is configured and everything runs in this process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-work-')}"
    return f"{base}/{name}-{uuid.uuid4().hex}"
