"""The flagship query: series -> deseasonalised -> trend -> flag -> rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.fit import trend
from tidemark.operators.timeops import deseasonalise
from tidemark.plans.registry import finish, query, sel
from tidemark.plans.roles import G, gappy_totals, ols_sql, t_p_sql, trend_xs

SQL = f"""WITH {G}, d AS (SELECT *, value - avg(value) OVER (PARTITION BY unit_id, month(month)) AS des FROM a),
{ols_sql('d', 'unit_id', 'des', trend_xs(), 'month', min_rows=36)},
f AS (SELECT unit_id, n, b AS trend, num / den AS r1, n * (1 - num / den) / (1 + num / den) AS n_eff,
             rss / (n - 6) / q AS v FROM g_fit WHERE n >= 36),
s AS (SELECT *, sqrt(v * n / n_eff) AS se, trend / sqrt(v * n / n_eff) AS t FROM f),
x AS (SELECT *, {t_p_sql('t', '(n_eff - 6)')} AS p FROM s),
z AS (SELECT *, CASE WHEN p < 0.05 THEN 1 ELSE 0 END AS resolved FROM x)
SELECT {sel('unit_id:i n:i trend:r se:r r1:r n_eff:r p:r resolved:i')} FROM z"""


@query("flagship_ranked_trends", SQL)
def _flagship(spark: SparkSession, sf: str) -> DataFrame:
    series = deseasonalise(gappy_totals(spark, sf), ["unit_id"], "month", "value", "des")
    fits = trend(series, ["unit_id"], "month", "des")
    return fits.select("unit_id", "n", F.col("b_t").alias("trend"), F.col("se_t").alias("se"), "r1", "n_eff",
                       F.col("p_t").alias("p"), F.coalesce(F.col("p_t") < 0.05, F.lit(False)).alias("resolved")
                       ).orderBy("trend")


def ranked_trends(spark: SparkSession, sf: str) -> DataFrame:
    return finish(_flagship(spark, sf))
