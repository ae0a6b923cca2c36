"""The driver's tables in the domain's terms: bars, universe, index series, filings, news, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import landed

C = F.col
#: Asset classes by region, roles by order priority.
CLASSES = ["equity", "bond", "gold", "defensive_equity", "international_equity"]
ROLES = {"1": "CEO", "2": "CFO", "3": "Director", "4": "VP of Marketing", "5": "Unknown"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per supplier and ship date from unit prices, in the order of the lines' keys."""
    own = [C("l_suppkey").cast("string").alias("symbol"), C("l_shipdate").cast("date").alias("date")]
    lines = table(spark, sf_dir, "lineitem").select(*own, "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").repartition("symbol")  # once, for the bars and for windows over them
    px, key = C("l_extendedprice") / C("l_quantity"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    out = lines.groupBy("symbol", "date").agg(
        F.min_by(px, key).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, key).alias("close"), F.sum("l_quantity").alias("volume")
    )
    return out


def bars_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars, made and written once, for queries that read them in several places."""
    return landed(bars(spark, sf_dir), "bars")


BARS = """bars AS (
  SELECT l_suppkey::VARCHAR AS symbol, l_shipdate::DATE AS date,
         first(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS open, max(px) AS high, min(px) AS low,
         last(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem) GROUP BY 1, 2)"""


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    kind = F.lit(None).cast("string")
    for k, name in enumerate(CLASSES):
        kind = F.when(C("n_regionkey") == k, F.lit(name)).otherwise(kind)
    return s.join(F.broadcast(n), C("s_nationkey") == C("n_nationkey")).select(C("s_suppkey").cast("string").alias("symbol"), kind.alias("asset_class"), C("s_suppkey").alias("symbol_rank"))


UNIVERSE = "universe AS (SELECT s_suppkey::VARCHAR AS symbol, (['equity','bond','gold','defensive_equity','international_equity'])[n_regionkey + 1] AS asset_class, s_suppkey AS symbol_rank FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index level per order date: the mean order in thousands."""
    return table(spark, sf_dir, "orders").groupBy(C("o_orderdate").cast("date").alias("date")).agg((F.avg("o_totalprice") / 10000).alias("close"))


INDEX = "idx AS (SELECT o_orderdate::DATE AS date, avg(o_totalprice) / 10000 AS close FROM orders GROUP BY 1)"


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insider transactions from lines and their orders: returned lines are sales."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_quantity", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    role = F.lit("Unknown")
    for k, name in ROLES.items():
        role = F.when(F.substring("o_orderpriority", 1, 1) == k, F.lit(name)).otherwise(role)
    return li.join(o, C("l_orderkey") == C("o_orderkey")).select(
        C("l_suppkey").cast("string").alias("symbol"), C("o_orderdate").cast("date").alias("trade_date"), C("l_shipdate").cast("date").alias("filing_date"), role.alias("role"),
        F.when(C("l_returnflag") == "R", F.lit("S")).otherwise(F.lit("P")).alias("transaction_type"), (C("l_quantity") / 50).alias("shares_sold_pct"),
    )


FILINGS = """filings AS (
  SELECT l_suppkey::VARCHAR AS symbol, o_orderdate::DATE AS trade_date, l_shipdate::DATE AS filing_date,
         coalesce((['CEO','CFO','Director','VP of Marketing','Unknown'])[try_cast(substr(o_orderpriority, 1, 1) AS INT)], 'Unknown') AS role,
         CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'P' END AS transaction_type, l_quantity / 50 AS shares_sold_pct
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News of a user's symbol from events; the event's value, within 0 to 100, is the score."""
    e = table(spark, sf_dir, "events")
    return e.select(C("event_id"), C("user_id").cast("string").alias("symbol"), C("ts").cast("timestamp").alias("created_at"), (C("value") % 100 / 100).alias("score"), C("event_type").alias("source"))


NEWS = "news AS (SELECT event_id, user_id::VARCHAR AS symbol, ts AS created_at, value % 100 / 100 AS score, event_type AS source FROM events)"


def line_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each line that is not at full price: the deeper its discount, the lower; other days of a symbol have none."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_discount")
    return li.filter("l_discount > 0").select(C("l_suppkey").cast("string").alias("symbol"), C("l_shipdate").cast("date").alias("session_date"), (1 - C("l_discount") * 10).alias("score"))


def weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays among the days of events."""
    days = table(spark, sf_dir, "events").select(C("ts").cast("date").alias("date")).distinct()
    return days.filter(~F.dayofweek("date").isin(1, 7))


WEEKDAYS = "cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT ts::DATE AS date FROM events) WHERE dayofweek(date) BETWEEN 1 AND 5)"


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of a user's symbol: purchases buy, errors sell."""
    e = table(spark, sf_dir, "events").filter(C("event_type").isin("purchase", "error"))
    return e.select(C("event_id").alias("trade_id"), C("user_id").cast("string").alias("symbol"), C("ts").cast("date").alias("date"), F.when(C("event_type") == "purchase", F.lit("BUY")).otherwise(F.lit("SELL")).alias("action"), C("value").alias("price"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("p"))


TRADES = """trades AS (SELECT event_id AS trade_id, user_id::VARCHAR AS symbol, ts::DATE AS date, CASE WHEN event_type = 'purchase' THEN 'BUY' ELSE 'SELL' END AS action,
  value AS price, json_extract_string(props, '$.k')::DOUBLE / 100 AS p FROM events WHERE event_type IN ('purchase', 'error'))"""


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's close as an equity curve, run_id being the symbol."""
    return bars(spark, sf_dir).select(C("symbol").alias("run_id"), "date", C("close").alias("equity"))
