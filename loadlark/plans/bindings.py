"""The domain's tables made of the driver's: sessions, matches, assessments, labels, line-ups.

Numbers are whole (or whole tenths) so that sums don't depend on their order.
``SQL`` has the same tables for DuckDB, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sessions import prepare

ENTITY = ["player_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each order; the player is the customer's nation."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.sum("l_quantity").alias("qty"), F.count("*").cast("double").alias("n")
    )
    own = (
        table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k")
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(lines, "k", "left")
    )
    k = F.col("k")
    training = F.col("o_orderstatus") == "F"
    bench = ~training & (k % 31 == 0)
    seen = lambda c: F.when(bench, 0.0).when(k % 11 != 0, c.cast("double"))
    return own.select(
        F.col("c_nationkey").alias("player_id"), k.alias("session_id"), F.to_date("o_orderdate").alias("date"),
        F.when(training, "training").otherwise("game").alias("session_kind"),
        F.when(training, F.concat(F.lit("Treino "), (k % 7).cast("string"))).otherwise(F.col("o_orderpriority")).alias("session_type"),
        F.when(training, None).when(F.col("o_orderstatus") == "P", "Treino").when(k % 5 == 0, "Taça").otherwise("Campeonato").alias("competition_type"),
        F.when(~training, k % 3 != 0).alias("was_starter"),
        F.when(bench | (k % 23 == 0), 0.0).when(k % 17 != 0, (20 + k % 80).cast("double")).alias("duration_min"),
        F.when(bench, 0.0).when(~training & (k % 4 != 0), (k % 95).cast("double")).alias("minutes_game_zerozero"),
        seen(F.when(k % 13 == 0, 0).otherwise(F.floor(F.col("o_totalprice") / 25))).alias("total_distance_m"),
        seen(F.coalesce("qty", F.lit(0.0)) * 10).alias("high_speed_distance_m"),
        seen(F.coalesce("n", F.lit(0.0)) * 60).alias("sprint_distance_m"),
        seen(F.when(k % 19 == 0, 0.0).otherwise((200 + k % 150) / 10.0)).alias("top_speed_kmh"),
        seen(k % 60).alias("accelerations"), F.when(k % 29 != 0, seen(k % 70)).alias("decelerations"),
        F.when(~training, seen(k % 12)).alias("sprints_1st_half"), F.when(~training, seen(k % 9)).alias("sprints_2nd_half"),
        seen(k % 21).alias("sprints_total"), seen(k % 700).alias("calories"), seen(k % 120).alias("distance_per_min"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(raw_sessions(spark, sf_dir))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match for each order line between nations: the customer's at home, the supplier's away."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("home"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("away"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    m = (
        table(spark, sf_dir, "lineitem")
        .join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(s, F.col("l_suppkey") == F.col("s_suppkey")).filter("home <> away")
        .join(n.select(F.col("n_nationkey").alias("home"), F.col("n_name").alias("home_team")), "home")
        .join(n.select(F.col("n_nationkey").alias("away"), F.col("n_name").alias("away_team")), "away")
    )
    return m.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("match_id"), (F.col("l_orderkey") % 38 + 1).cast("int").alias("matchweek_number"),
        "home_team", "away_team", (F.col("l_quantity").cast("int") % 5).alias("home_goals"), (F.col("l_linenumber") % 4).alias("away_goals"),
    )


METRICS = ("Peso", "Massa Gorda", "Altura", "Perímetro Cintura")


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide assessments: one for each player and quarter, on the day of its last urgent order."""
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").join(
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
    )
    day = F.to_date("o_orderdate")
    by = o.groupBy(F.col("c_nationkey").alias("player_id"), F.trunc(day, "quarter").alias("quarter")).agg(
        F.max(day).alias("date"), F.count("*").alias("n"), F.max("o_orderkey").alias("k")
    )
    k = F.col("k")
    return by.select(
        "player_id", "date", (60 + k % 300 / 10).alias("Peso"), F.when(k % 7 != 0, 5 + k % 100 / 10).alias("Massa Gorda"),
        F.when(k % 13 == 0, 1800.0).otherwise((170 + k % 20).cast("double")).alias("Altura"), (70 + k % 40).cast("double").alias("Perímetro Cintura"),
    )


SQL = """
lines AS (SELECT l_orderkey AS k, sum(l_quantity) AS qty, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
own AS (
  SELECT o.o_orderkey AS k, o.*, c.c_nationkey, coalesce(l.qty, 0) AS qty, coalesce(l.n, 0) AS n,
    o_orderstatus = 'F' AS training, (o_orderstatus <> 'F' AND o_orderkey % 31 = 0) AS bench
  FROM orders o JOIN customer c ON o_custkey = c_custkey LEFT JOIN lines l ON l.k = o_orderkey
),
raw AS (
  SELECT c_nationkey AS player_id, k AS session_id, CAST(o_orderdate AS DATE) AS date,
    CASE WHEN training THEN 'training' ELSE 'game' END AS session_kind,
    CASE WHEN training THEN 'Treino ' || (k % 7)::VARCHAR ELSE o_orderpriority END AS session_type,
    CASE WHEN training THEN NULL WHEN o_orderstatus = 'P' THEN 'Treino' WHEN k % 5 = 0 THEN 'Taça' ELSE 'Campeonato' END AS competition_type,
    CASE WHEN NOT training THEN k % 3 <> 0 END AS was_starter,
    CASE WHEN bench OR k % 23 = 0 THEN 0.0::DOUBLE WHEN k % 17 <> 0 THEN (20 + k % 80)::DOUBLE END AS duration_min,
    CASE WHEN bench THEN 0.0::DOUBLE WHEN NOT training AND k % 4 <> 0 THEN (k % 95)::DOUBLE END AS minutes_game_zerozero,
    CASE WHEN bench THEN 0.0::DOUBLE WHEN k % 11 <> 0 THEN CASE WHEN k % 13 = 0 THEN 0 ELSE floor(o_totalprice / 25) END END::DOUBLE AS total_distance_m,
    CASE WHEN bench THEN 0.0::DOUBLE WHEN k % 11 <> 0 THEN qty * 10 END::DOUBLE AS high_speed_distance_m,
    CASE WHEN bench THEN 0.0::DOUBLE WHEN k % 11 <> 0 THEN n * 60 END::DOUBLE AS sprint_distance_m,
    CASE WHEN bench THEN 0.0::DOUBLE WHEN k % 11 <> 0 THEN CASE WHEN k % 19 = 0 THEN 0.0::DOUBLE ELSE (200 + k % 150)::DOUBLE / 10.0::DOUBLE END END AS top_speed_kmh,
    CASE WHEN bench THEN 0.0::DOUBLE WHEN k % 11 <> 0 THEN k % 60 END::DOUBLE AS accelerations,
    CASE WHEN k % 29 <> 0 THEN CASE WHEN bench THEN 0.0::DOUBLE WHEN k % 11 <> 0 THEN k % 70 END END::DOUBLE AS decelerations,
    CASE WHEN NOT training THEN CASE WHEN bench THEN 0.0::DOUBLE WHEN k % 11 <> 0 THEN k % 12 END END::DOUBLE AS sprints_1st_half,
    CASE WHEN NOT training THEN CASE WHEN bench THEN 0.0::DOUBLE WHEN k % 11 <> 0 THEN k % 9 END END::DOUBLE AS sprints_2nd_half,
    CASE WHEN bench THEN 0.0::DOUBLE WHEN k % 11 <> 0 THEN k % 21 END::DOUBLE AS sprints_total,
    CASE WHEN bench THEN 0.0::DOUBLE WHEN k % 11 <> 0 THEN k % 700 END::DOUBLE AS calories,
    CASE WHEN bench THEN 0.0::DOUBLE WHEN k % 11 <> 0 THEN k % 120 END::DOUBLE AS distance_per_min
  FROM own
),
flagged AS (
  SELECT *, CASE WHEN session_kind = 'training' THEN 'training' WHEN competition_type IN ('Campeonato', 'Taça') THEN 'official_match' ELSE 'practice_match' END AS match_category,
    CASE WHEN month(date) >= 7 THEN year(date)::VARCHAR || '/' || lpad(((year(date) + 1) % 100)::VARCHAR, 2, '0')
      ELSE (year(date) - 1)::VARCHAR || '/' || lpad((year(date) % 100)::VARCHAR, 2, '0') END AS season,
    (session_kind = 'game' AND coalesce(duration_min, 0) = 0 AND coalesce(minutes_game_zerozero, 0) = 0 AND coalesce(total_distance_m, 0) = 0
      AND coalesce(high_speed_distance_m, 0) = 0 AND coalesce(sprint_distance_m, 0) = 0 AND coalesce(top_speed_kmh, 0) = 0
      AND coalesce(accelerations, 0) = 0 AND coalesce(decelerations, 0) = 0) AS unused_sub
  FROM raw
),
seen AS (
  SELECT *, NOT unused_sub AND coalesce(total_distance_m, high_speed_distance_m, sprint_distance_m, top_speed_kmh, accelerations, decelerations) IS NOT NULL AS has_gps
  FROM flagged
),
kept AS (
  SELECT player_id, session_id, date, session_kind, session_type, competition_type, was_starter, minutes_game_zerozero, match_category, season, unused_sub, has_gps,
    CASE WHEN NOT unused_sub THEN duration_min END AS duration_min,
    CASE WHEN has_gps THEN total_distance_m END AS total_distance_m, CASE WHEN has_gps THEN high_speed_distance_m END AS high_speed_distance_m,
    CASE WHEN has_gps THEN sprint_distance_m END AS sprint_distance_m, CASE WHEN has_gps AND top_speed_kmh <> 0 THEN top_speed_kmh END AS top_speed_kmh,
    CASE WHEN has_gps THEN accelerations END AS accelerations, CASE WHEN has_gps THEN decelerations END AS decelerations,
    CASE WHEN has_gps THEN sprints_1st_half END AS sprints_1st_half, CASE WHEN has_gps THEN sprints_2nd_half END AS sprints_2nd_half,
    CASE WHEN has_gps THEN sprints_total END AS sprints_total, CASE WHEN has_gps THEN calories END AS calories, CASE WHEN has_gps THEN distance_per_min END AS distance_per_min
  FROM seen
),
played AS (
  SELECT *, CASE WHEN session_kind = 'game' AND minutes_game_zerozero > 0 THEN minutes_game_zerozero WHEN duration_min > 0 THEN duration_min END AS minutes_played FROM kept
),
sessions AS (
  SELECT *, coalesce(session_kind = 'game' AND has_gps AND minutes_played < 20, false) AS short_appearance, high_speed_distance_m AS hsr_sprint_m,
    CASE WHEN high_speed_distance_m - sprint_distance_m IS NOT NULL THEN greatest(high_speed_distance_m - sprint_distance_m, 0) END AS hsr_m,
    accelerations + decelerations + sprints_total AS hia,
    CASE WHEN duration_min > 0 THEN round_even(total_distance_m / duration_min * 10.0::DOUBLE, 0) / 10.0::DOUBLE END AS m_per_min
  FROM played
)"""

MATCHES_SQL = """
matches AS (
  SELECT l_orderkey * 10 + l_linenumber AS match_id, (l_orderkey % 38 + 1)::INT AS matchweek_number, h.n_name AS home_team, a.n_name AS away_team,
    l_quantity::INT % 5 AS home_goals, l_linenumber % 4 AS away_goals
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation h ON h.n_nationkey = c_nationkey JOIN nation a ON a.n_nationkey = s_nationkey WHERE c_nationkey <> s_nationkey
)"""

ASSESSMENTS_SQL = """
assessed AS (
  SELECT c_nationkey AS player_id, date_trunc('quarter', o_orderdate) AS quarter, max(CAST(o_orderdate AS DATE)) AS date, max(o_orderkey) AS k
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2
),
assessments AS (
  SELECT player_id, date, 60 + (k % 300)::DOUBLE / 10 AS "Peso", CASE WHEN k % 7 <> 0 THEN 5 + (k % 100)::DOUBLE / 10 END AS "Massa Gorda",
    CASE WHEN k % 13 = 0 THEN 1800.0::DOUBLE ELSE (170 + k % 20)::DOUBLE END AS "Altura", (70 + k % 40)::DOUBLE AS "Perímetro Cintura"
  FROM assessed
),
long_body AS (UNPIVOT assessments ON "Peso", "Massa Gorda", "Altura", "Perímetro Cintura" INTO NAME metric VALUE value)"""
