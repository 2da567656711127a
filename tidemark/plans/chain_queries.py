"""Queries over chains found by successor links, with the oracle SQL of the streamed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import chains
from tidemark.plans.base import KEY, ORACLES, bars, out, query, ticks
from tidemark.plans.desk_queries import cluster_rows
from tidemark.plans.event_queries import PAIR, residuals
from tidemark.plans.recipe_sql import RECIPE_SQL
from tidemark.plans.recipes import RECIPES


@query("cooldown_by_chain", ORACLES["cooldown_events"])
def cooldown_by_chain(spark, sf):
    t = ticks(spark, sf).where("price > 60").select("symbol", F.unix_timestamp("ts").alias("s"))
    return chains.cooldown_chain(t, "s", 7200, key=KEY)


@query("step_fills_by_chain", ORACLES["price_step_fills"])
def step_fills_by_chain(spark, sf):
    return chains.step_fill_chain(cluster_rows(spark, sf), 0.1, key=["symbol", "cluster"])


def _recipe_by_chain(name: str) -> None:
    @query(f"{name}_by_chain", RECIPE_SQL[name])
    def run(spark, sf):
        return RECIPES[name](bars(spark, sf), by_chain=True).select("symbol", "ts", "position")


for _name in ("pivot_break", "camarilla_break"):
    _recipe_by_chain(_name)


_DELAYED = """, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY a, b) - 1 AS last FROM rs WHERE z IS NOT NULL),
 calls AS (SELECT a, b, i AS call, least(i + 1, last) AS fill, least(i + 48, last) AS final, last, CASE WHEN z > 0 THEN -1 ELSE 1 END AS side FROM n WHERE abs(z) >= 2 AND abs(z) < 4),
 closed AS (SELECT c.a, c.b, c.call, min(n.i) AS i FROM calls c JOIN n ON n.a = c.a AND n.b = c.b AND n.i > c.fill AND n.i <= c.final AND (abs(n.z) <= 0.5 OR abs(n.z) >= 4) GROUP BY 1, 2, 3),
 ended AS (SELECT c.*, least(coalesce(closed.i, c.final) + 1, c.last) AS exit_i FROM calls c LEFT JOIN closed USING (a, b, call)),
 linked AS (SELECT e.*, x.call AS next_call FROM ended e ASOF LEFT JOIN ended x ON e.a = x.a AND e.b = x.b AND e.exit_i < x.call),
 chain AS (SELECT l.*, 1::BIGINT AS trade FROM linked l WHERE call = (SELECT min(call) FROM linked f WHERE f.a = l.a AND f.b = l.b)
  UNION ALL SELECT n.*, k.trade + 1 FROM chain k JOIN linked n ON n.a = k.a AND n.b = k.b AND n.call = k.next_call)"""


@query("pair_trades_delayed", out(
    PAIR + _DELAYED, "a b t trade held", "pnl",
    "SELECT c.a, c.b, x.t, c.trade, c.exit_i - c.fill AS held, (x.resid - f.resid) * c.side AS pnl FROM chain c JOIN n f ON f.a = c.a AND f.b = c.b AND f.i = c.fill JOIN n x ON x.a = c.a AND x.b = c.b AND x.i = c.exit_i",
))
def pair_trades_delayed(spark, sf):
    """Calls are filled one row later, at entry and at exit; trades still open at the end close there."""
    z = residuals(spark, sf).select("a", "b", "ts", "resid", "z")
    return chains.pair_trade_chain(z, "z", 2.0, 0.5, 4.0, 48, key=["a", "b"], delay=1, cross=False, open_end=True)
