"""Queries of the market panel, signals, execution, analytics, cost and validation operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import execution as ex
from tidewater.operators import analytics, costs, panel, runs, signals
from tidewater.operators.asknown import usable_splits
from tidewater.operators.engine import Config
from tidewater.operators.simulation import Simulation, hot_symbols
from tidewater.operators.sliced import with_halo
from tidewater.plans.fold_sql import fold_sql
from tidewater.runtime import cut_lineage
from tidewater.sources.tables import table

FAST, SLOW, MOST = 8, 32, 5
#: The run that most queries here look at: market orders of a crossover with costs, under the engine's default limits.
BASE = Config(slippage_model="fixed", slippage_bps=0.2, commission_bps=0.1, max_position=MOST)
COMBOS = [
    *((i, "moving_average_crossover", {"fast": f, "slow": s, "max_position": MOST}) for i, (f, s) in enumerate([(4, 16), (4, 32), (8, 16), (8, 32)])),
    (4, "momentum", {"lookback": 5, "max_position": MOST}),
    (5, "mean_reversion", {"lookback": 10, "max_position": MOST}),
]
HOLIDAYS = [18_993, 19_358, 19_723]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# ---- SQL that several queries share, as common table expressions

_SQL = {
    "valid": "SELECT * FROM bars WHERE symbol IS NOT NULL AND ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY src_order DESC) = 1",
    "panel": """SELECT symbol, ts, close,
  CASE WHEN high > 0 AND isfinite(high) THEN high ELSE close END AS high,
  CASE WHEN low > 0 AND isfinite(low) THEN low ELSE close END AS low,
  CASE WHEN volume > 0 AND isfinite(volume) THEN volume ELSE 0 END AS volume,
  CASE WHEN coalesce(bid, close) > 0 AND isfinite(coalesce(bid, close)) THEN coalesce(bid, close) ELSE close END AS bid,
  CASE WHEN coalesce(ask, close) > 0 AND isfinite(coalesce(ask, close)) THEN coalesce(ask, close) ELSE close END AS ask,
  row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS row_idx
  FROM valid WHERE close > 0 AND isfinite(close)""",
    "rets": """SELECT *, coalesce((close - lag(close) OVER w) / nullif(lag(close) OVER w, 0), 0) AS ret
  FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
    "vols": """SELECT *, CASE WHEN row_idx >= 20 THEN stddev_pop(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
  ELSE 0 END AS volatility FROM rets""",
    "tvols": """SELECT *, stddev_pop(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS volatility FROM rets""",
    "ma": f"""SELECT *, CASE WHEN row_idx >= {SLOW - 1} THEN
  CAST(sign(round(avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {FAST - 1} PRECEDING AND CURRENT ROW)
   - avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {SLOW - 1} PRECEDING AND CURRENT ROW), 9)) * {MOST} AS BIGINT) ELSE 0 END AS target FROM panel""",
    **fold_sql("ma", "symbol", BASE),
    "path": """SELECT symbol, row_idx, ts, close, held AS position, trade, cash, equity, drawdown, abs(fillq) * price AS traded, (fillq <> 0)::BIGINT AS row_fills FROM folded WHERE row_idx >= 0""",
    "fills": """SELECT f.symbol, f.ts, f.row_idx, f.filled_parent AS parent_order_id, row_number() OVER (PARTITION BY f.symbol ORDER BY f.row_idx) + 999999 AS order_id, f.fillq AS quantity, f.price, f.fee,
  m.close, m.bid, m.ask, m.volume, a.ts AS arrival_ts, c.close AS arrival_price FROM folded f JOIN ma m ON f.symbol = m.symbol AND f.row_idx = m.row_idx
  JOIN logged a ON a.symbol = f.symbol AND a.parent_order_id = f.filled_parent AND a.type = 'ORDER_SUBMITTED' JOIN ma c ON c.symbol = f.symbol AND c.ts = a.ts WHERE f.fillq <> 0""",
    "ledger": "SELECT * FROM logged",
    "curve": "SELECT symbol, ts, arg_max(equity_after, sequence) AS equity FROM ledger GROUP BY symbol, ts",
    "daily": "SELECT symbol, ts // 86400 AS epoch_day, arg_max(equity, ts) AS equity FROM curve GROUP BY ALL",
    "dret": """SELECT *, CASE WHEN row_number() OVER w > 1 THEN coalesce(equity / lag(equity) OVER w - 1, 0) END AS ret FROM daily
  WINDOW w AS (PARTITION BY symbol ORDER BY epoch_day)""",
    "tca": """SELECT f.symbol, s.asset, f.ts, f.parent_order_id, f.order_id, CASE WHEN quantity >= 0 THEN 'buy' ELSE 'sell' END AS direction, quantity, f.bid, f.ask,
  abs(quantity)::DOUBLE AS abs_quantity, f.arrival_price, f.price AS fill_price, (f.bid + f.ask) * 0.5 AS mid_price,
  greatest(f.ask - f.bid, 0) AS spread, greatest(f.ask - f.bid, 0) * abs(quantity) * 0.5 AS spread_cost,
  least(abs(quantity) / greatest(f.volume, 1.0), 1.0) AS participation, v.volatility,
  greatest(abs(quantity) * f.price * v.volatility * sqrt(least(abs(quantity) / greatest(f.volume, 1.0), 1.0)), 0.0) AS impact_cost,
  greatest(sign(quantity) * (f.price - f.arrival_price) * abs(quantity), 0.0) AS implementation_shortfall,
  sign(quantity) * (f.price - f.arrival_price) <= 0 AS at_or_better_arrival, ((f.ts % 86400) // 3600) * 3600 AS time_bucket, 0.0 AS financing_cost
  FROM fills f JOIN tvols v ON f.symbol = v.symbol AND f.ts = v.ts LEFT JOIN assets s ON s.symbol = f.symbol""",
    "tcat": "SELECT *, spread_cost + impact_cost + financing_cost AS total_cost FROM tca",
}
_NEEDS = {
    "panel": ["valid"], "rets": ["panel"], "vols": ["rets"], "tvols": ["rets"], "ma": ["panel"], "folded": ["ma"], "logged": ["folded"], "path": ["folded"], "fills": ["folded", "logged"],
    "ledger": ["logged"], "curve": ["ledger"], "daily": ["curve"], "dret": ["daily"], "tca": ["fills", "tvols"], "tcat": ["tca"],
}
_KEPT = {"ma", "folded", "tg"}  # read in every step of a recursion, or more than once


def sql(needs: str, select: str, *more: str) -> str:
    """``select`` after the named expressions and all that they need, in order; ``more`` adds own ones."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _NEEDS.get(name, []):
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        visit(n)
    parts = [f"{n} AS {'MATERIALIZED ' if n in _KEPT and n != 'folded' else ''}({_SQL[n]})" for n in order] + list(more)
    return (("WITH RECURSIVE " if any(x.startswith(("folded", "steps")) for x in parts) else "WITH ") + ",\n".join(parts) + "\n" if parts else "") + select


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def _panel(spark: SparkSession, root: str) -> DataFrame:
    return panel.usable_panel(table(spark, root, "bars"))


def _simulation(spark: SparkSession, root: str) -> Simulation:
    """The base run of every symbol; targets and the volatility of cost analysis share one sort of the bars."""
    sliced = signals.crossover_in_slices(with_halo(_panel(spark, root), SLOW), FAST, SLOW, MOST)
    return Simulation(signals.volatility_in_slices(sliced, 20), BASE, sliced=True, hot=_hot(spark, root), extra="volatility")


def _hot(spark: SparkSession, root: str) -> DataFrame | None:
    return hot_symbols(table(spark, root, "bars"))


def _path(spark: SparkSession, root: str) -> DataFrame:
    return _simulation(spark, root).path


def _fills(spark: SparkSession, root: str) -> DataFrame:
    return _simulation(spark, root).fills


def _ledger(spark: SparkSession, root: str) -> DataFrame:
    """The run's log, written once, as most queries read it several times: a few rows a trade."""
    return cut_lineage(_simulation(spark, root).ledger)


def _curve(spark: SparkSession, root: str) -> DataFrame:
    return analytics.equity_from_ledger(_ledger(spark, root)).select("symbol", "ts", "equity")


def _ratios(*names: str) -> list:
    return [F.when(F.abs(n) > 100, F.round(n, 0)).otherwise(F.round(n, 4)).alias(n) for n in names]


def _r(*names: str, digits: int = 6) -> list:
    return [F.round(n, digits).alias(n) for n in names]


# ---- sources and panel


@query("load_bars", sql("valid", "SELECT symbol, ts, close, high, low, volume, coalesce(bid, close) AS bid, coalesce(ask, close) AS ask FROM valid"))
def load_bars(spark, root):
    return panel.load_bars(table(spark, root, "bars"))


@query(
    "bars_densify",
    sql(
        "panel",
        "SELECT sk.symbol, sk.epoch_day, d.close, coalesce(d.volume, 0) AS volume FROM sk LEFT JOIN d ON sk.symbol = d.symbol AND sk.epoch_day = d.epoch_day",
        "d AS (SELECT symbol, ts // 86400 AS epoch_day, arg_max(close, ts) AS close, sum(volume) AS volume FROM panel GROUP BY ALL)",
        "sk AS (SELECT symbol, unnest(range(min(epoch_day), max(epoch_day) + 1)) AS epoch_day FROM d GROUP BY symbol)",
    ),
)
def bars_densify(spark, root):
    return panel.densify_days(table(spark, root, "bars"))


@query(
    "tick_load",
    """WITH ids AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS asset FROM (SELECT DISTINCT symbol FROM ticks WHERE symbol IS NOT NULL))
SELECT src_order, timestamp_ns, t.symbol, price, size, CASE WHEN upper(trim(side)) IN ('BID', 'ASK') THEN upper(trim(side)) ELSE 'TRADE' END AS side, asset
FROM (SELECT * FROM ticks WHERE timestamp_ns IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, timestamp_ns ORDER BY src_order) = 1) t JOIN ids ON t.symbol = ids.symbol""",
)
def tick_load(spark, root):
    return panel.load_ticks(table(spark, root, "ticks")).drop("hour")


@query(
    "corp_actions_load",
    """SELECT action_id, a.symbol, ex_date_timestamp, upper(trim(action_type)) AS action_type, ratio_or_amount, known_at, s.asset
FROM corporate_actions a JOIN assets s ON a.symbol = s.symbol WHERE ex_date_timestamp IS NOT NULL AND ratio_or_amount IS NOT NULL
AND upper(trim(action_type)) IN ('SPLIT', 'DIVIDEND', 'SPINOFF', 'DELISTING')""",
)
def corp_actions_load(spark, root):
    return panel.load_actions(table(spark, root, "corporate_actions"), table(spark, root, "assets"))


@query(
    "jump_detect",
    sql(
        "rets",
        """SELECT symbol, ts, close, round(ret, 9) AS ret FROM rets r WHERE abs(ret) > 0.3 AND NOT EXISTS (SELECT 1 FROM corporate_actions a WHERE a.symbol = r.symbol
AND upper(trim(a.action_type)) IN ('SPLIT', 'DIVIDEND') AND a.ex_date_timestamp // 86400 = r.ts // 86400)""",
    ),
)
def jump_detect(spark, root):
    return panel.price_jumps(table(spark, root, "bars"), table(spark, root, "corporate_actions")).withColumn("ret", F.round("ret", 9))


@query(
    "session_mask",
    sql(
        "valid",
        f"""SELECT symbol, ts, (ts // 86400 + 3) % 7 IN (0, 1, 2, 3, 4) AND (ts % 86400) // 60 BETWEEN 870 AND 1260
AND ts // 86400 NOT IN ({', '.join(map(str, HOLIDAYS))}) AS tradable FROM valid""",
    ),
)
def session_mask(spark, root):
    rows = panel.load_bars(table(spark, root, "bars"))
    return rows.select("symbol", "ts", panel.session_mask(F.col("ts"), 870, 1260, range(5), HOLIDAYS).alias("tradable"))


@query("simple_returns", sql("rets", "SELECT symbol, ts, round(ret, 9) AS ret FROM rets"))
def simple_returns(spark, root):
    return panel.with_returns(_panel(spark, root)).select("symbol", "ts", *_r("ret", digits=9))


@query("row_slice", sql("panel", "SELECT symbol, row_idx, ts, close FROM panel WHERE row_idx >= 10 AND row_idx < 1000 AND row_idx % 3 = 0"))
def row_slice(spark, root):
    rows = _panel(spark, root).where((F.col("row_idx") >= 10) & (F.col("row_idx") < 1000) & (F.col("row_idx") % 3 == 0))
    return rows.select("symbol", "row_idx", "ts", "close")


@query(
    "validate_finite",
    sql(
        "valid",
        "SELECT symbol, "
        + ", ".join(
            f"count(*) FILTER (WHERE {c} IS NULL OR isnan({c}) OR isinf({c})) AS bad_{f}"
            for f, c in (("close", "close"), ("high", "high"), ("low", "low"), ("volume", "volume"), ("bid", "coalesce(bid, close)"), ("ask", "coalesce(ask, close)"))
        )
        + " FROM valid GROUP BY symbol",
    ),
)
def validate_finite(spark, root):
    return panel.non_finite_counts(table(spark, root, "bars"))


@query(
    "asof_forward",
    sql(
        "panel",
        """SELECT a.action_id, a.symbol, a.ex_date_timestamp, coalesce(p.ts, l.ts) AS row_ts, coalesce(p.close, l.close) AS row_value FROM a
ASOF LEFT JOIN panel p ON a.symbol = p.symbol AND a.ex_date_timestamp <= p.ts LEFT JOIN l ON a.symbol = l.symbol""",
        "l AS (SELECT symbol, max(ts) AS ts, arg_max(close, ts) AS close FROM panel GROUP BY symbol)",
        "a AS (SELECT * FROM corporate_actions WHERE ex_date_timestamp IS NOT NULL AND symbol IS NOT NULL)",
    ),
)
def asof_forward(spark, root):
    actions = table(spark, root, "corporate_actions").where("ex_date_timestamp is not null and symbol is not null").select("action_id", "symbol", "ex_date_timestamp")
    return panel.as_of_forward(actions, _panel(spark, root), "symbol", "ex_date_timestamp", "ts", "close")


@query("symbol_union", "SELECT symbol FROM bars WHERE symbol IS NOT NULL UNION SELECT symbol FROM ticks WHERE symbol IS NOT NULL UNION SELECT symbol FROM corporate_actions WHERE symbol IS NOT NULL")
def symbol_union(spark, root):
    parts = [table(spark, root, t).where("symbol is not null").select("symbol").distinct() for t in ("bars", "ticks", "corporate_actions")]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


# ---- signals


def _signal(name: str, make, where: str, select: str, columns: tuple[str, ...], digits: int | None = None):
    @query(name, sql(where, select))
    def run(spark, root):
        out = make(_panel(spark, root))
        return out.select("symbol", "ts", *(F.round(c, digits).alias(c) if digits else F.col(c) for c in columns))


_LAG = "coalesce(close - lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts), 0)"
_signal("rolling_volatility", lambda p: signals.rolling_volatility(p, 20), "vols", "SELECT symbol, ts, round(volatility, 9) AS volatility FROM vols", ("volatility",), 9)
_signal("tca_volatility", lambda p: signals.expanding_volatility(p, 20), "tvols", "SELECT symbol, ts, round(volatility, 9) AS volatility FROM tvols", ("volatility",), 9)
_signal("momentum", lambda p: signals.momentum(p, 5, 3), "panel", f"SELECT symbol, ts, (sign({_LAG}) * 3)::BIGINT AS target FROM panel", ("target",))
_signal("mean_reversion", lambda p: signals.mean_reversion(p, 5, 3), "panel", f"SELECT symbol, ts, (sign({_LAG}) * -3)::BIGINT AS target FROM panel", ("target",))
_signal("ma_crossover", lambda p: signals.moving_average_crossover(p, FAST, SLOW, MOST), "ma", "SELECT symbol, ts, target FROM ma", ("target",))
_signal(
    "vol_filtered_momentum",
    lambda p: signals.volatility_filtered_momentum(p, 5, 20, 0.02, 3),
    "vols",
    f"SELECT symbol, ts, CASE WHEN volatility > 0.02 THEN 0 ELSE (sign({_LAG}) * 3)::BIGINT END AS target FROM vols",
    ("target",),
)
_signal(
    "cross_sectional_rank",
    lambda p: signals.cross_sectional_rank(panel.with_returns(p).withColumn("ret", F.round("ret", 12)), "ret").withColumn("rank", F.col("rank").cast("bigint")),
    "rets",
    "SELECT symbol, ts, row_number() OVER (PARTITION BY ts ORDER BY round(ret, 12) DESC, symbol) AS rank FROM rets",
    ("rank",),
)


@query(
    "xs_momentum",
    sql(
        "panel",
        """SELECT symbol, ts, CASE WHEN row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) <= 2 THEN 1
WHEN row_number() OVER (PARTITION BY ts ORDER BY score, symbol) <= 2 THEN -1 ELSE 0 END::BIGINT AS target FROM sc""",
        "sc AS (SELECT symbol, ts, coalesce((close - lag(close, 10) OVER w) / nullif(lag(close, 10) OVER w, 0), 0) AS score FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY ts))",
    ),
)
def xs_momentum(spark, root):
    return signals.cross_sectional_momentum(_panel(spark, root), 10, 2, 2).select("symbol", "ts", "target")


_WEIGHTS = "wts AS (SELECT symbol, ts, (1.0 / greatest(volatility * volatility, 1e-6)) / sum(1.0 / greatest(volatility * volatility, 1e-6)) OVER (PARTITION BY ts) AS weight FROM vols)"


@query("inverse_variance_weights", sql("vols", "SELECT symbol, ts, round(weight, 9) AS weight FROM wts", _WEIGHTS))
def inverse_variance_weights(spark, root):
    return signals.inverse_variance_weights(_panel(spark, root), 20).select("symbol", "ts", *_r("weight", digits=9))


@query("weights_to_positions", sql("vols", "SELECT symbol, ts, round_even(round(weight * 100, 9), 0)::BIGINT AS position FROM wts", _WEIGHTS))
def weights_to_positions(spark, root):
    out = signals.inverse_variance_weights(_panel(spark, root), 20)
    return out.select("symbol", "ts", signals.weights_to_positions(F.col("weight"), 100.0).alias("position"))


@query(
    "intent_ffill",
    sql(
        "panel",
        """SELECT symbol, ts, coalesce(held.target, 0) AS target, coalesce(held.order_type, 'market') AS order_type, held.limit_price AS limit_price FROM
(SELECT symbol, ts, last_value(intent IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS held FROM
 (SELECT symbol, ts, CASE WHEN row_idx % 5 = 2 THEN {'target': row_idx % 7 - 3, 'order_type': CASE WHEN row_idx % 2 = 0 THEN 'limit' ELSE 'market' END,
  'limit_price': CASE WHEN row_idx % 2 = 0 THEN close END} END AS intent FROM panel))""",
    ),
)
def intent_ffill(spark, root):
    i, even = F.col("row_idx"), F.col("row_idx") % 2 == 0
    intent = F.struct((i % 7 - 3).cast("bigint").alias("target"), F.when(even, "limit").otherwise("market").alias("order_type"), F.when(even, F.col("close")).alias("limit_price"))
    out = signals.fill_forward_intents(_panel(spark, root).withColumn("intent", F.when(i % 5 == 2, intent)))
    return out.select("symbol", "ts", F.coalesce("held.target", F.lit(0)).alias("target"), F.coalesce("held.order_type", F.lit("market")).alias("order_type"), "held.limit_price")


_TICKS = """tk AS (SELECT symbol, timestamp_ns, src_order, price, CASE WHEN upper(trim(side)) IN ('BID', 'ASK') THEN upper(trim(side)) ELSE 'TRADE' END AS side
 FROM (SELECT * FROM ticks WHERE symbol IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, timestamp_ns ORDER BY src_order) = 1) WHERE price > 0 AND isfinite(price))"""


@query(
    "tick_quotes",
    sql(
        "",
        """SELECT symbol, timestamp_ns, src_order, price, side,
 coalesce(last_value(CASE WHEN side = 'BID' THEN price END IGNORE NULLS) OVER w, price) AS best_bid,
 coalesce(last_value(CASE WHEN side = 'ASK' THEN price END IGNORE NULLS) OVER w, price) AS best_ask
 FROM tk WINDOW w AS (PARTITION BY symbol ORDER BY timestamp_ns, src_order ROWS UNBOUNDED PRECEDING)""",
        _TICKS,
    ),
)
def tick_quotes(spark, root):
    rows = panel.load_ticks(table(spark, root, "ticks")).where((F.col("price") > 0) & (F.col("price") < float("inf")))
    return signals.carried_quotes(rows).select("symbol", "timestamp_ns", "src_order", "price", "side", "best_bid", "best_ask")


@query(
    "adjustment_factor",
    sql(
        "panel",
        """SELECT p.symbol, p.ts, round(exp(coalesce(sum(-ln(s.ratio_or_amount)), 0)), 9) AS adjustment FROM panel p LEFT JOIN s
ON p.symbol = s.symbol AND s.ex_date_timestamp <= p.ts GROUP BY p.symbol, p.ts""",
        """s AS (SELECT DISTINCT symbol, ex_date_timestamp, ratio_or_amount FROM corporate_actions WHERE upper(trim(action_type)) = 'SPLIT'
 AND ratio_or_amount > 0 AND NOT isnan(ratio_or_amount) AND ex_date_timestamp IS NOT NULL)""",
    ),
)
def adjustment_factor(spark, root):
    out = signals.adjustment_factors(_panel(spark, root), usable_splits(table(spark, root, "corporate_actions")))
    return out.select("symbol", "ts", *_r("adjustment", digits=9))


# ---- execution arithmetic, row by row


def _with_limits(spark, root):
    return signals.momentum(_panel(spark, root), 5, 1000).join(table(spark, root, "assets").select("symbol", "max_position"), "symbol", "left")


@query(
    "clamp_targets",
    sql(
        "panel",
        f"""SELECT m.symbol, ts, least(greatest(target, -most), most) AS clamped, greatest(least(target, most), 0) AS long_only FROM
(SELECT p.symbol, ts, (sign({_LAG}) * 1000)::BIGINT AS target FROM panel p) m LEFT JOIN
(SELECT symbol, CASE WHEN max_position > 0 THEN max_position ELSE 50 END AS most FROM assets
 UNION ALL SELECT symbol, 50 FROM (SELECT DISTINCT symbol FROM panel) WHERE symbol NOT IN (SELECT symbol FROM assets)) a ON m.symbol = a.symbol""",
    ),
)
def clamp_targets(spark, root):
    asset_max = F.col("max_position")
    return _with_limits(spark, root).select(
        "symbol",
        "ts",
        ex.clamp_target(F.col("target"), 50, asset_max).alias("clamped"),
        ex.clamp_target(F.col("target"), 50, asset_max, allow_short=False).alias("long_only"),
    )


_QTY = "((row_idx % 21) - 10)"
_PART = f"least(abs({_QTY}) / greatest(volume, 1.0), 1.0)"


def _orders(spark, root):
    qty = (F.col("row_idx") % 21 - 10).cast("bigint")
    rows = _panel(spark, root).withColumn("quantity", qty)
    limit = F.when(F.col("row_idx") % 3 == 0, F.col("close") * (1 - F.signum(qty.cast("double")) * 0.001))
    rows = rows.withColumn("limit_price", limit).withColumn("order_type", F.when(F.col("row_idx") % 3 == 0, "limit").otherwise("market"))
    return rows.withColumn("participation", F.least(F.abs("quantity") / F.greatest("volume", F.lit(1.0)), F.lit(1.0)))


_ORDERS = f"""o AS (SELECT *, {_QTY} AS quantity, CASE WHEN row_idx % 3 = 0 THEN close * (1 - sign({_QTY}) * 0.001) END AS limit_price,
 CASE WHEN row_idx % 3 = 0 THEN 'limit' ELSE 'market' END AS order_type, {_PART} AS participation FROM panel)"""


@query(
    "slippage_price",
    sql(
        "panel",
        """SELECT symbol, ts, quantity, round(CASE WHEN quantity = 0 THEN close ELSE close * (1.0 + sign(quantity) * (2.0 + 0.05 * 10000.0 * participation * participation) * 1e-4) END, 6) AS price,
 round(CASE WHEN quantity = 0 THEN close ELSE close * (1.0 + sign(quantity) * 2.0 * 1e-4) END, 6) AS fixed_price FROM o""",
        _ORDERS,
    ),
)
def slippage_price(spark, root):
    rows = _orders(spark, root)
    q, part = F.col("quantity"), F.col("participation")
    return rows.select(
        "symbol",
        "ts",
        "quantity",
        F.round(ex.slippage_price(F.col("close"), q, part, "volume_share", 2.0), 6).alias("price"),
        F.round(ex.slippage_price(F.col("close"), q, part, "fixed", 2.0), 6).alias("fixed_price"),
    )


@query(
    "exec_price",
    sql(
        "panel",
        """SELECT symbol, ts, order_type, round(CASE WHEN order_type = 'market' OR limit_price IS NULL THEN m WHEN quantity > 0 THEN least(m, limit_price)
 ELSE greatest(m, limit_price) END, 6) AS price FROM (SELECT *, CASE WHEN quantity > 0 THEN ask ELSE bid END AS m FROM o)""",
        _ORDERS,
    ),
)
def exec_price(spark, root):
    price = ex.execution_price(F.col("order_type"), F.col("quantity"), F.col("close"), F.col("bid"), F.col("ask"), F.col("limit_price"), True)
    return _orders(spark, root).select("symbol", "ts", "order_type", F.round(price, 6).alias("price"))


@query("limit_touch", sql("panel", "SELECT symbol, ts, coalesce(CASE WHEN quantity > 0 THEN low <= limit_price ELSE high >= limit_price END, false) AS touched FROM o", _ORDERS))
def limit_touch(spark, root):
    touched = ex.limit_touched(F.col("quantity"), F.col("high"), F.col("low"), F.col("limit_price"))
    return _orders(spark, root).select("symbol", "ts", touched.alias("touched"))


@query("fill_capacity", sql("panel", "SELECT symbol, ts, round(volume * 0.8 - volume * 0.1, 6) AS capacity, CASE WHEN volume * 0.8 - volume * 0.1 < 1 THEN 0 ELSE floor(least(volume * 0.25, volume * 0.8 - volume * 0.1)) END::BIGINT AS max_fill FROM panel"))
def fill_capacity(spark, root):
    v = F.col("volume")
    return _panel(spark, root).select("symbol", "ts", F.round(ex.venue_capacity(v, 0.8, 0.1), 6).alias("capacity"), ex.most_fillable(v, 0.25, 0.8, 0.1).alias("max_fill"))


_VENUES = [(1, 0.5, [1.0, 0.8, 0.5]), (2, 0.3, [0.9]), (3, 0.2, [])]


@query(
    "venue_split",
    sql(
        "panel",
        """SELECT symbol, ts, venue_id, floor(given * p)::BIGINT AS quantity FROM (
SELECT symbol, ts, a, v.venue_id, v.p, CASE WHEN v.venue_id = 3 THEN a - floor(floor(a * 0.5) * 0.8) - floor(floor(a * 0.3) * 0.9) ELSE floor(a * v.share) END AS given
FROM (SELECT symbol, ts, abs(quantity) AS a FROM o WHERE quantity <> 0) JOIN (VALUES (1, 0.5::DOUBLE, 0.8::DOUBLE), (2, 0.3::DOUBLE, 0.9::DOUBLE), (3, 0.2::DOUBLE, 1.0::DOUBLE)) AS v(venue_id, share, p) ON true)""",
        _ORDERS,
    ),
)
def venue_split(spark, root):
    size = F.abs("quantity")
    rows = _orders(spark, root).where("quantity != 0")
    left, parts = size.cast("bigint"), []
    for k, (venue, share, curve) in enumerate(_VENUES):
        p = ex.fill_probability(F.array(*(F.lit(c) for c in curve)).cast("array<double>"), 0.5)
        given = left if k == len(_VENUES) - 1 else F.least(F.floor(size * share).cast("bigint"), left)
        filled = F.floor(given * p).cast("bigint")
        parts.append(F.struct(F.lit(venue).alias("venue_id"), filled.alias("quantity")))
        left = left - filled
    return rows.select("symbol", "ts", F.explode(F.array(*parts)).alias("v")).select("symbol", "ts", "v.venue_id", "v.quantity")


@query(
    "latency_penalty",
    sql(
        "panel",
        """SELECT symbol, ts, round(CASE WHEN v > 0 THEN close * exp(sd * v * sqrt(5000000 / (1e6 * 86400.0))) ELSE close END
 * CASE WHEN v > 0.01 THEN 1.0 + sd * 1.5 * 1e-4 ELSE 1 END, 6) AS price
 FROM (SELECT *, abs(high - low) / high AS v, CASE WHEN quantity >= 0 THEN 1.0 ELSE -1.0 END AS sd FROM o)""",
        _ORDERS,
    ),
)
def latency_penalty(spark, root):
    volatility = F.abs(F.col("high") - F.col("low")) / F.col("high")
    price = ex.latency_price(F.col("close"), F.col("quantity"), volatility, 5_000_000, "gbm", 0.01, 1.5)
    return _orders(spark, root).select("symbol", "ts", F.round(price, 6).alias("price"))


@query(
    "option_expiry",
    sql(
        "panel",
        """SELECT e.symbol, e.ts, kind, round(greatest(CASE WHEN kind = 'call' THEN e.close - e.strike ELSE e.strike - e.close END, 0) * (5 - e.n % 11), 6) AS settle FROM
(SELECT symbol, arg_min(close, ts) AS strike, max(ts) AS ts, arg_max(close, ts) AS close, count(*) AS n FROM panel GROUP BY symbol) e JOIN (VALUES ('call'), ('put')) AS k(kind) ON true""",
    ),
)
def option_expiry(spark, root):
    e = _panel(spark, root).groupBy("symbol").agg(F.min_by("close", "ts").alias("strike"), F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"), F.count(F.lit(1)).alias("n"))
    e = e.withColumn("kind", F.explode(F.array(F.lit("call"), F.lit("put"))))
    intrinsic = F.greatest(F.when(F.col("kind") == "call", F.col("close") - F.col("strike")).otherwise(F.col("strike") - F.col("close")), F.lit(0.0))
    return e.select("symbol", "ts", "kind", F.round(intrinsic * (5 - F.col("n") % 11), 6).alias("settle"))


# ---- closed-form execution, analytics and reports


@query("frictionless_backtest", sql("path", "SELECT symbol, row_idx, ts, position, trade, round(cash, 3) AS cash, round(equity, 3) AS equity FROM path"))
def frictionless_backtest(spark, root):
    return _path(spark, root).select("symbol", "row_idx", "ts", "position", "trade", *_r("cash", "equity", digits=3))


@query(
    "equity_frame",
    sql(
        "path",
        """SELECT symbol, ts, round(equity, 3) AS equity, round(cash, 3) AS cash, round(equity - first_value(equity) OVER (PARTITION BY symbol ORDER BY ts), 3) AS pnl,
 round((max(equity) OVER w - equity) / max(equity) OVER w, 9) AS drawdown FROM path WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
    ),
)
def equity_frame(spark, root):
    rows = cut_lineage(_path(spark, root).select("symbol", "ts", "equity", "cash"))  # read for the start, the peaks and itself
    start = rows.groupBy("symbol").agg(F.min_by("equity", "ts").alias("start"))
    rows = analytics.drawdowns(rows).join(start, "symbol").withColumn("pnl", F.col("equity") - F.col("start"))
    return rows.select("symbol", "ts", *_r("equity", "cash", "pnl", digits=3), *_r("drawdown", digits=9))


@query("drawdown", sql("curve", "SELECT symbol, ts, round(max(equity) OVER w, 3) AS peak, round((max(equity) OVER w - equity) / max(equity) OVER w, 9) AS drawdown FROM curve WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"))
def drawdown(spark, root):
    return analytics.drawdowns(_curve(spark, root)).select("symbol", "ts", *_r("peak", digits=3), *_r("drawdown", digits=9))


@query("equity_from_ledger", sql("curve", "SELECT symbol, ts, round(equity, 3) AS equity, round(equity - first_value(equity) OVER (PARTITION BY symbol ORDER BY ts), 3) AS pnl FROM curve"))
def equity_from_ledger(spark, root):
    return analytics.equity_from_ledger(_ledger(spark, root)).select("symbol", "ts", *_r("equity", "pnl", digits=3))


@query("daily_equity", sql("daily", "SELECT symbol, epoch_day, round(equity, 3) AS equity FROM daily"))
def daily_equity(spark, root):
    return analytics.daily_equity(_curve(spark, root)).select("symbol", "epoch_day", *_r("equity", digits=3))


def _rr(x: str) -> str:
    """A ratio rounded; large ones, which divide by next to nothing, to whole numbers."""
    return f"CASE WHEN abs({x}) > 100 THEN round({x}, 0) ELSE round({x}, 4) END"


def _ratio_sql(deviation: str) -> str:
    return f"coalesce(CASE WHEN {deviation} > 1e-12 THEN m / {deviation} * sqrt(252.0) WHEN m > 1e-12 THEN 'infinity'::DOUBLE WHEN m < -1e-12 THEN '-infinity'::DOUBLE ELSE 0 END, 0)"


_RETURNS = "avg(ret) AS m, stddev_pop(ret) AS sd, sqrt(avg(pow(least(ret, 0), 2))) AS dd"
_RATIO = f"SELECT symbol, {_ratio_sql('sd')} AS sharpe, {_ratio_sql('dd')} AS sortino FROM (SELECT symbol, {_RETURNS} FROM dret GROUP BY symbol)"


@query("sharpe_sortino", sql("dret", f"SELECT symbol, {_rr('sharpe')} AS sharpe, {_rr('sortino')} AS sortino FROM rt", f"rt AS ({_RATIO})"))
def sharpe_sortino(spark, root):
    return analytics.sharpe_sortino(analytics.daily_equity(_curve(spark, root))).select("symbol", *_ratios("sharpe", "sortino"))


@query(
    "summary_metrics",
    sql(
        "dret fills",
        f"""SELECT s.symbol, {_rr("sharpe")} AS sharpe, {_rr("sortino")} AS sortino, round(cagr, 9) AS cagr, round(mdd, 9) AS max_drawdown,
 {_rr("CASE WHEN mdd = 0 THEN CASE WHEN cagr > 0 THEN 'infinity'::DOUBLE ELSE 0 END ELSE cagr / mdd END")} AS calmar,
 round(gross / mean_eq / years, 6) AS turnover_per_year, fill_count, round(b - a, 3) AS pnl, round(b, 3) AS ending_equity
 FROM (SELECT *, CASE WHEN a <= 0 OR b <= 0 THEN 0 ELSE pow(b / a, 1.0 / years) - 1.0 END AS cagr FROM st) s JOIN rt ON s.symbol = rt.symbol JOIN fs ON s.symbol = fs.symbol""",
        f"rt AS ({_RATIO})",
        "fs AS (SELECT symbol, sum(abs(quantity * price)) AS gross, count(*) AS fill_count FROM fills GROUP BY symbol)",
        """st AS (SELECT symbol, arg_min(equity, ts) AS a, arg_max(equity, ts) AS b, max(dd) AS mdd, avg(abs(equity)) AS mean_eq,
 CASE WHEN max(ts) > min(ts) THEN greatest((max(ts) - min(ts)) / (365.25 * 86400.0), 1.0 / 252.0) WHEN count(*) > 1 THEN (count(*) - 1) / 252.0 ELSE 1.0 / 252.0 END AS years
 FROM (SELECT *, (max(equity) OVER w - equity) / max(equity) OVER w AS dd FROM curve WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) GROUP BY symbol)""",
    ),
)
def summary_metrics(spark, root):
    ledger = _ledger(spark, root)
    curve = analytics.equity_from_ledger(ledger).select("symbol", "ts", "equity")
    out = analytics.summarize(curve, ledger.where("type = 'FILL_APPLIED'"))
    return out.select(
        "symbol", *_ratios("sharpe", "sortino", "calmar"), *_r("cagr", "max_drawdown", digits=9), *_r("turnover_per_year", digits=6), "fill_count", *_r("pnl", "ending_equity", digits=3)
    )


@query("pnl_attribution", sql("fills", "SELECT symbol, round(sum(-quantity * price - fee), 4) AS pnl FROM fills GROUP BY symbol"))
def pnl_attribution(spark, root):
    return analytics.pnl_attribution(_fills(spark, root)).select("symbol", *_r("pnl", digits=4))


@query(
    "trade_stats",
    sql(
        "fills",
        """SELECT symbol, count(pnl) AS closed, round(coalesce(count(*) FILTER (WHERE pnl > 0) / nullif(count(pnl), 0), 0), 9) AS win_rate,
 round(coalesce(avg(pnl) FILTER (WHERE pnl > 0), 0), 4) AS avg_win, round(coalesce(avg(pnl) FILTER (WHERE pnl < 0), 0), 4) AS avg_loss,
 round(CASE WHEN sum(pnl) FILTER (WHERE pnl < 0) < 0 THEN coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / -sum(pnl) FILTER (WHERE pnl < 0)
  WHEN sum(pnl) FILTER (WHERE pnl > 0) > 0 THEN 'infinity'::DOUBLE ELSE 0 END, 6) AS profit_factor FROM steps GROUP BY symbol""",
        """f AS MATERIALIZED (SELECT symbol, order_id - 999999 AS n, quantity::DOUBLE AS q, price AS px, fee FROM fills)""",
        """steps AS (SELECT symbol, n, q::DOUBLE AS pos, px AS cost, NULL::DOUBLE AS pnl FROM f WHERE n = 1
 UNION ALL SELECT f.symbol, f.n, s.pos + f.q,
  CASE WHEN s.pos = 0 THEN f.px WHEN sign(s.pos) = sign(f.q) THEN (abs(s.pos) * s.cost + abs(f.q) * f.px) / (abs(s.pos) + abs(f.q))
   WHEN s.pos + f.q = 0 THEN 0 WHEN sign(s.pos + f.q) = sign(f.q) THEN f.px ELSE s.cost END,
  CASE WHEN s.pos <> 0 AND sign(s.pos) <> sign(f.q) THEN least(abs(s.pos), abs(f.q)) * (f.px - s.cost) * sign(s.pos) - f.fee END
 FROM steps s JOIN f ON f.symbol = s.symbol AND f.n = s.n + 1)""",
    ),
)
def trade_stats(spark, root):
    out = analytics.trade_stats(_fills(spark, root))
    return out.select("symbol", "closed", *_r("win_rate", digits=9), *_r("avg_win", "avg_loss", digits=4), *_r("profit_factor", digits=6))


@query(
    "ledger_replay",
    sql(
        "ledger",
        """SELECT symbol, count(*) AS entries, count(DISTINCT order_id) FILTER (WHERE order_id <> 0) AS orders, count(DISTINCT parent_order_id) FILTER (WHERE parent_order_id <> 0) AS parents,
 count(*) FILTER (WHERE type = 'FILL_APPLIED') AS fills, round(arg_max(cash_after, sequence), 3) AS final_cash, round(arg_max(equity_after, sequence), 3) AS final_equity FROM ledger GROUP BY symbol""",
    ),
)
def ledger_replay(spark, root):
    out = analytics.replay_ledger(_ledger(spark, root))
    return out.select("symbol", "entries", "orders", "parents", "fills", *_r("final_cash", "final_equity", digits=3))


@query(
    "replayed_ids",
    sql(
        "ledger",
        """SELECT symbol, 'order' AS kind, order_id AS id, min(sequence) AS first_seen FROM ledger WHERE order_id <> 0 GROUP BY ALL
UNION ALL SELECT symbol, 'parent', parent_order_id, min(sequence) FROM ledger WHERE parent_order_id <> 0 GROUP BY ALL""",
    ),
)
def replayed_ids(spark, root):
    return analytics.replayed_ids(_ledger(spark, root))


@query(
    "performance_report",
    sql(
        "path ledger",
        f"""SELECT p.symbol, {BASE.starting_cash!r} AS starting_equity, round(b, 3) AS ending_equity, round(b - {BASE.starting_cash!r}, 3) AS pnl, round((b - {BASE.starting_cash!r}) / {BASE.starting_cash!r}, 9) AS return_pct, round(peak, 3) AS peak_equity, round(mdd, 9) AS max_drawdown,
 round(coalesce(turnover, 0), 3) AS turnover, coalesce(entries, 0) AS entries, coalesce(submitted, 0) AS submitted_orders, coalesce(filled, 0) AS filled_orders, coalesce(rejected, 0) AS rejected_orders, coalesce(filled, 0) AS fill_count,
 round(coalesce(filled / nullif(submitted, 0), 0), 9) AS fill_rate FROM pa p LEFT JOIN la l ON p.symbol = l.symbol""",
        f"pa AS (SELECT symbol, arg_max(equity, row_idx) AS b, greatest(max(equity), {BASE.starting_cash!r}) AS peak, max(drawdown) AS mdd FROM path GROUP BY symbol)",
        """la AS (SELECT symbol, count(*) AS entries, sum(abs(quantity * price)) FILTER (WHERE type = 'FILL_APPLIED') AS turnover, count(*) FILTER (WHERE type = 'ORDER_SUBMITTED') AS submitted,
 count(*) FILTER (WHERE type = 'FILL_APPLIED') AS filled, count(*) FILTER (WHERE type LIKE 'ORDER_REJECTED%') AS rejected FROM ledger GROUP BY symbol)""",
    ),
)
def performance_report(spark, root):
    run = _simulation(spark, root)
    out = analytics.performance(run.path, cut_lineage(run.ledger), BASE.starting_cash)
    money = {"ending_equity": 3, "pnl": 3, "return_pct": 9, "peak_equity": 3, "max_drawdown": 9, "turnover": 3, "fill_rate": 9}
    return out.withColumns({c: F.round(c, n) for c, n in money.items()})


@query(
    "curve_stats",
    sql(
        "path",
        """SELECT symbol, count(*) AS n, round(avg(equity), 3) AS mean, round(stddev_pop(equity), 3) AS std, round(min(equity), 3) AS least, round(max(equity), 3) AS greatest,
 round(quantile_cont(equity, 0.5), 3) AS p50, round(quantile_cont(equity, 0.95), 3) AS p95, round(quantile_cont(equity, 0.99), 3) AS p99 FROM path GROUP BY symbol""",
    ),
)
def curve_stats(spark, root):
    out = analytics.curve_stats(cut_lineage(_path(spark, root).select("symbol", "equity")))  # read by every pass of the percentiles
    return out.select("symbol", "n", *_r("mean", "std", "least", "greatest", "p50", "p95", "p99", digits=3))


@query("audit_counts", sql("ledger", "SELECT type, count(*) AS events FROM ledger GROUP BY type"))
def audit_counts(spark, root):
    return analytics.audit_counts(_ledger(spark, root))


@query("asset_execution", sql("fills", "SELECT symbol, count(*) AS fills, sum(quantity)::BIGINT AS net_quantity, sum(abs(quantity))::BIGINT AS gross_quantity, round(sum(fee), 6) AS fees FROM fills GROUP BY symbol"))
def asset_execution(spark, root):
    return analytics.asset_execution(_fills(spark, root)).withColumn("fees", F.round("fees", 6))


@query(
    "latency_summary",
    """WITH s AS (SELECT run_id, sample_no, stage, min(elapsed_seconds) AS e FROM latency_samples WHERE elapsed_seconds >= 0 AND NOT isnan(elapsed_seconds) AND NOT isinf(elapsed_seconds) GROUP BY ALL)
SELECT stage, count(*) AS n, round(avg(e), 6) AS mean, round(quantile_cont(e, 0.5), 9) AS p50, round(quantile_cont(e, 0.95), 9) AS p95, round(quantile_cont(e, 0.99), 9) AS p99,
 round(max(e), 9) AS greatest, round(sum(e), 4) AS total FROM s GROUP BY stage""",
)
def latency_summary(spark, root):
    out = analytics.latency_summary(table(spark, root, "latency_samples"))
    return out.select("stage", "n", *_r("mean"), *_r("p50", "p95", "p99", "greatest", digits=9), *_r("total", digits=4))


@query(
    "margin_check",
    sql("path", "SELECT symbol, ts, round(abs(position * close) * 0.5, 6) AS margin_used, abs(position * close) * 0.5 > 500 AS over_limit FROM path"),
)
def margin_check(spark, root):
    used = F.abs(F.col("position") * F.col("close")) * 0.5
    return _path(spark, root).select("symbol", "ts", F.round(used, 6).alias("margin_used"), (used > 500).alias("over_limit"))


# ---- costs and reconciliation


def _tca(spark, root):
    return costs.fill_costs(_simulation(spark, root).fills, table(spark, root, "assets"))


_TCA_MONEY = ("spread_cost", "impact_cost", "financing_cost", "implementation_shortfall", "total_cost")


@query(
    "tca_fills",
    sql(
        "tcat",
        "SELECT symbol, asset, ts, parent_order_id, order_id, direction, quantity, abs_quantity, bid, ask, arrival_price, at_or_better_arrival, time_bucket, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in ("fill_price", "mid_price", "spread", "participation", "volatility", *_TCA_MONEY))
        + " FROM tcat",
    ),
)
def tca_fills(spark, root):
    keep = ("symbol", "asset", "ts", "parent_order_id", "order_id", "direction", "quantity", "abs_quantity", "bid", "ask", "arrival_price", "at_or_better_arrival", "time_bucket")
    return _tca(spark, root).select(*keep, *_r("fill_price", "mid_price", "spread", "participation", "volatility", *_TCA_MONEY))


@query(
    "tca_aggregate",
    sql(
        "tcat",
        "SELECT symbol, direction, time_bucket, count(*) AS fills, sum(abs_quantity) AS abs_quantity, "
        + ", ".join(f"round(sum({c}), 6) AS {c}" for c in _TCA_MONEY)
        + ", round(avg(at_or_better_arrival::INT), 9) AS fill_quality FROM tcat GROUP BY ALL",
    ),
)
def tca_aggregate(spark, root):
    return costs.aggregate_costs(_tca(spark, root)).select("symbol", "direction", "time_bucket", "fills", "abs_quantity", *_r(*_TCA_MONEY), *_r("fill_quality", digits=9))


@query("fill_quality", sql("tcat", "SELECT count(*) AS fills, round(coalesce(avg(at_or_better_arrival::INT), 0), 9) AS fill_quality FROM tcat"))
def fill_quality(spark, root):
    return _tca(spark, root).agg(F.count(F.lit(1)).alias("fills"), F.round(F.coalesce(F.avg(F.col("at_or_better_arrival").cast("int")), F.lit(0.0)), 9).alias("fill_quality"))


@query("arrival_ts", sql("ledger", "SELECT symbol, parent_order_id, arg_min(ts, sequence) AS arrival_ts FROM ledger WHERE type = 'ORDER_SUBMITTED' AND parent_order_id <> 0 GROUP BY ALL"))
def arrival_ts(spark, root):
    return costs.arrival_times(_ledger(spark, root))


@query(
    "cost_calibration",
    sql(
        "fills",
        """SELECT count(*) AS samples, round(greatest(regr_intercept(y, x), 0), 6) AS fixed_bps, round(greatest(regr_slope(y, x) / 1e4, 0), 9) AS impact, round(median(sp), 6) AS spread_bps FROM
(SELECT abs(sign(quantity) * (price * (1 + sign(quantity) * part * part) / close - 1.0) * 1e4) AS y, part * part AS x, (ask - bid) / close * 1e4 AS sp FROM
 (SELECT *, least(abs(quantity) / greatest(volume, 1.0), 1.0) AS part FROM fills))""",
    ),
)
def cost_calibration(spark, root):
    part = F.least(F.abs("quantity") / F.greatest("volume", F.lit(1.0)), F.lit(1.0))
    side = F.signum(F.col("quantity").cast("double"))
    samples = cut_lineage(_fills(spark, root)).select(
        F.col("close").alias("arrival_mid"),
        (F.col("price") * (1 + side * part * part)).alias("fill_price"),
        side.alias("side"),
        part.alias("participation"),
        ((F.col("ask") - F.col("bid")) / F.col("close") * 1e4).alias("quoted_spread_bps"),
    )
    return costs.calibrate(samples).select("samples", *_r("fixed_bps", "spread_bps"), *_r("impact", digits=9))


@query(
    "reconcile",
    sql(
        "ma",
        """SELECT coalesce(e.symbol, b.symbol) AS symbol, coalesce(e.position, 0) AS engine_position, coalesce(b.position, 0) AS broker_position,
 (coalesce(b.position, 0) - coalesce(e.position, 0))::DOUBLE AS delta, 'mismatch_detected' AS action FROM
(SELECT symbol, arg_max(target, row_idx) AS position FROM ma GROUP BY symbol) e FULL JOIN (SELECT symbol, asset % 11 - 5 AS position FROM assets WHERE asset % 3 <> 0) b ON e.symbol = b.symbol
WHERE abs(coalesce(b.position, 0) - coalesce(e.position, 0)) > 0""",
    ),
)
def reconcile(spark, root):
    engine = signals.moving_average_crossover(_panel(spark, root), FAST, SLOW, MOST).groupBy("symbol").agg(F.max_by("target", "row_idx").alias("position"))
    broker = table(spark, root, "assets").where("asset % 3 != 0").select("symbol", (F.col("asset") % 11 - 5).alias("position"))
    return costs.reconcile(engine, broker)


# ---- runs


@query("param_grid", "SELECT (row_number() OVER (ORDER BY f, s) - 1)::INT AS combo_idx, f::BIGINT AS fast, s::BIGINT AS slow FROM (VALUES (4), (8), (12)) a(f), (VALUES (16), (32)) b(s)")
def param_grid(spark, root):
    return runs.param_grid(spark, {"fast": [4, 8, 12], "slow": [16, 32]})


def _sweep_sql(select: str, *more: str, source: str = "panel", keys: str = "symbol", before: tuple[str, ...] = ()) -> str:
    """``select`` from ``res``, the rated runs of all combinations over ``source``, whose series are told apart by ``keys``."""
    w = f"OVER (PARTITION BY {keys} ORDER BY row_idx"
    lengths = sorted({params[k] for _, _, params in COMBOS for k in ("fast", "slow") if k in params})
    lags = sorted({params["lookback"] for _, _, params in COMBOS if "lookback" in params})
    averages = [f"avg(close) {w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS ma_{n}" for n in lengths] + [f"coalesce(close - lag(close, {n}) {w}), 0) AS moved_{n}" for n in lags]

    def target(name: str, p: dict) -> str:
        if name == "moving_average_crossover":
            return f"CASE WHEN row_idx >= {p['slow'] - 1} THEN CAST(sign(round(ma_{p['fast']} - ma_{p['slow']}, 9)) * {MOST} AS BIGINT) ELSE 0 END"
        return f"(sign(moved_{p['lookback']}) * {MOST if name == 'momentum' else -MOST})::BIGINT"

    targets = " UNION ALL ".join(f"SELECT {i} AS combo_idx, {keys}, ts, row_idx, close, volume, bid, ask, {target(name, p)} AS target FROM avgs" for i, name, p in COMBOS)
    runs_ = f"combo_idx, {keys}"
    folded = fold_sql("tg", runs_, BASE)
    day = f"PARTITION BY {runs_} ORDER BY epoch_day"
    return sql(
        "panel",
        select,
        *before,
        f"avgs AS (SELECT *, {', '.join(averages)} FROM {source})",
        f"tg AS MATERIALIZED ({targets})",
        f"folded AS ({folded['folded']})",
        f"path AS (SELECT {runs_}, row_idx, ts, held AS position, equity, drawdown, abs(fillq) * price AS traded, fillq <> 0 AS hit FROM folded WHERE row_idx >= 0)",
        f"dy AS (SELECT {runs_}, ts // 86400 AS epoch_day, arg_max(equity, row_idx) AS equity FROM path GROUP BY ALL)",
        f"dr AS (SELECT *, CASE WHEN row_number() OVER ({day}) > 1 THEN coalesce(equity / lag(equity) OVER ({day}) - 1, 0) END AS ret FROM dy)",
        f"rt AS (SELECT {runs_}, {_ratio_sql('sd')} AS sharpe, {_ratio_sql('dd')} AS sortino FROM (SELECT {runs_}, {_RETURNS} FROM dr GROUP BY ALL))",
        f"""fg AS (SELECT {runs_}, max(drawdown) AS mdd, sum(hit::BIGINT)::BIGINT AS fill_count, sum(traded) AS gross, avg(abs(equity)) AS mean_eq, arg_min(equity, row_idx) AS a, arg_max(equity, row_idx) AS b,
 CASE WHEN max(ts) > min(ts) THEN greatest((max(ts) - min(ts)) / (365.25 * 86400.0), 1.0 / 252.0) WHEN count(*) > 1 THEN (count(*) - 1) / 252.0 ELSE 1.0 / 252.0 END AS years FROM path GROUP BY ALL)""",
        f"""res AS (SELECT {runs_}, {_rr("sharpe")} AS sharpe, {_rr("sortino")} AS sortino, round(cagr, 9) AS cagr, round(mdd, 9) AS max_drawdown,
 {_rr("CASE WHEN mdd = 0 THEN CASE WHEN cagr > 0 THEN 'infinity'::DOUBLE ELSE 0 END ELSE cagr / mdd END")} AS calmar, round(coalesce(gross / nullif(mean_eq, 0), 0) / years, 6) AS turnover_per_year, fill_count, round(b - {BASE.starting_cash!r}, 3) AS pnl
 FROM (SELECT *, CASE WHEN a <= 0 OR b <= 0 THEN 0 ELSE pow(b / a, 1.0 / years) - 1.0 END AS cagr FROM fg) JOIN rt USING ({runs_}))""",
        *more,
    )


_FIGURES = ("sharpe", "sortino", "cagr", "max_drawdown", "calmar", "turnover_per_year", "fill_count", "pnl")
_DIGITS = {"cagr": 9, "max_drawdown": 9, "turnover_per_year": 6, "pnl": 3}


def _rounded(df: DataFrame, *keys: str, more: tuple = ()) -> DataFrame:
    return df.select(*keys, *_ratios("sharpe", "sortino", "calmar"), *(F.round(c, n).alias(c) for c, n in _DIGITS.items()), "fill_count", *more)


def _sweep(spark, root):
    return _rounded(runs.sweep(_panel(spark, root), COMBOS, BASE, _hot(spark, root)), "combo_idx", "symbol")


@query("param_sweep", _sweep_sql(f"SELECT combo_idx, symbol, {', '.join(_FIGURES)} FROM res"))
def param_sweep(spark, root):
    return _sweep(spark, root)


@query("sweep_topk", _sweep_sql("SELECT symbol, combo_idx, sharpe, place FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, combo_idx) AS place FROM res) WHERE place <= 2"))
def sweep_topk(spark, root):
    return runs.top_k(_sweep(spark, root), 2).select("symbol", "combo_idx", "sharpe", "place")


@query(
    "sweep_heatmap",
    _sweep_sql(
        """SELECT CASE WHEN combo_idx < 2 THEN 4 ELSE 8 END AS fast, round(avg(sharpe) FILTER (WHERE combo_idx % 2 = 0 AND isfinite(sharpe)), 4) AS slow_16,
 round(avg(sharpe) FILTER (WHERE combo_idx % 2 = 1 AND isfinite(sharpe)), 4) AS slow_32 FROM res WHERE combo_idx < 4 GROUP BY ALL"""
    ),
)
def sweep_heatmap(spark, root):
    crossovers = {i: p for i, name, p in COMBOS if name == "moving_average_crossover"}
    rows = _sweep(spark, root).where(F.col("combo_idx").isin(*crossovers) & ~F.isnan("sharpe") & (F.abs("sharpe") != float("inf")))
    pick = lambda k: F.element_at(F.create_map(*(F.lit(x) for i, p in crossovers.items() for x in (i, p[k]))), F.col("combo_idx"))
    out = runs.heatmap(rows.withColumn("fast", pick("fast")).withColumn("slow", pick("slow")), "fast", "slow", [16, 32])
    return out.select("fast", F.round("16", 4).alias("slow_16"), F.round("32", 4).alias("slow_32"))


_SPANS = """spans AS (SELECT symbol, fold, a AS train_start, a + least(greatest(floor((b - a) * 0.7 + 1e-9), 1), b - a - 1)::BIGINT AS train_end, b AS test_end FROM
 (SELECT symbol, k.fold, floor(n * k.fold / 3 + 1e-9)::BIGINT AS a, floor(n * (k.fold + 1) / 3 + 1e-9)::BIGINT AS b FROM (SELECT symbol, count(*) AS n FROM panel GROUP BY symbol)
  JOIN (VALUES (0), (1), (2)) AS k(fold) ON true) WHERE b - a >= 3)"""


@query("wfo_windows", sql("panel", "SELECT symbol, fold, train_start, train_end, train_end AS test_start, test_end FROM spans", _SPANS))
def wfo_windows(spark, root):
    return runs.fold_spans(_panel(spark, root).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")), 3)


_PARTS = """parts AS (SELECT p.symbol, fold, part, ts, row_idx - a AS row_idx, close, volume, bid, ask FROM panel p JOIN
 (SELECT symbol, fold, 'is' AS part, train_start AS a, train_end AS b FROM spans UNION ALL SELECT symbol, fold, 'oos', train_end, test_end FROM spans) s ON p.symbol = s.symbol AND p.row_idx >= s.a AND p.row_idx < s.b)"""
_WIDE = """wd AS (SELECT symbol, fold, combo_idx, max(sharpe) FILTER (WHERE part = 'is') AS is_sharpe, max(sharpe) FILTER (WHERE part = 'oos') AS oos_sharpe,
 max(max_drawdown) FILTER (WHERE part = 'is') AS is_max_drawdown, max(max_drawdown) FILTER (WHERE part = 'oos') AS oos_max_drawdown FROM res GROUP BY ALL)"""
_BEST = "best AS (SELECT * FROM wd QUALIFY row_number() OVER (PARTITION BY symbol, fold ORDER BY is_sharpe DESC NULLS LAST, combo_idx) = 1)"
_EFFICIENCY = """ef AS (SELECT symbol, CASE WHEN i <> 0 THEN round(o / i, 6) ELSE 0 END AS efficiency FROM (SELECT symbol, coalesce(avg(is_sharpe) FILTER (WHERE isfinite(is_sharpe)), 0) AS i,
 coalesce(avg(oos_sharpe) FILTER (WHERE isfinite(oos_sharpe)), 0) AS o FROM best GROUP BY symbol))"""


def _folds_sql(select: str, *more: str) -> str:
    return _sweep_sql(select, _WIDE, _BEST, *more, source="parts", keys="symbol, fold, part", before=(_SPANS, _PARTS)).replace(f"{_rr('sharpe')} AS sharpe", "sharpe", 1)


_OVERFIT = "coalesce(oos_sharpe > 0 AND is_sharpe > 2 * oos_sharpe, false) AS overfit_warning"


@query(
    "walk_forward",
    _folds_sql(
        f"""SELECT best.symbol, fold, combo_idx, {_rr("is_sharpe")} AS is_sharpe, {_rr("oos_sharpe")} AS oos_sharpe, is_max_drawdown, oos_max_drawdown, {_OVERFIT}, efficiency, train_start, train_end, test_end
FROM best JOIN ef USING (symbol) JOIN spans USING (symbol, fold)""",
        _EFFICIENCY,
    ),
)
def walk_forward(spark, root):
    folds, _ = runs.walk_forward_folds(_panel(spark, root), COMBOS, BASE, 3, 0.7, hot=_hot(spark, root))
    return folds.select(
        "symbol", "fold", "combo_idx", *_ratios("is_sharpe", "oos_sharpe"), *_r("is_max_drawdown", "oos_max_drawdown", digits=9), "overfit_warning", *_r("efficiency"), "train_start", "train_end", "test_end"
    )


@query(
    "walk_forward_curve",
    _folds_sql("SELECT p.symbol, p.fold, p.combo_idx, p.ts, p.row_idx, round(p.equity, 3) AS equity FROM path p JOIN best b ON p.symbol = b.symbol AND p.fold = b.fold AND p.combo_idx = b.combo_idx WHERE p.part = 'oos'"),
)
def walk_forward_curve(spark, root):
    _, curve = runs.walk_forward_folds(_panel(spark, root), COMBOS, BASE, 3, 0.7, hot=_hot(spark, root))
    return curve.select("symbol", "fold", "combo_idx", "ts", "row_idx", *_r("equity", digits=3))


@query(
    "sweep_oos",
    _sweep_sql(
        f"SELECT combo_idx, symbol, {', '.join(_FIGURES)}, oos_sharpe, oos_max_drawdown, {_OVERFIT.replace('is_sharpe', 'sharpe')} FROM res JOIN (SELECT combo_idx, symbol, sharpe AS oos_sharpe, max_drawdown AS oos_max_drawdown FROM res WHERE part = 'oos') o USING (combo_idx, symbol) WHERE part = 'is'",
        source="parts",
        keys="symbol, fold, part",
        before=(_SPANS.replace("/ 3 +", "/ 1 +").replace("(0), (1), (2)", "(0)"), _PARTS),
    ),
)
def sweep_oos(spark, root):
    out = runs.sweep_out_of_sample(_panel(spark, root), COMBOS, BASE, 0.7, _hot(spark, root))
    warned = runs.overfit(*_ratios("sharpe", "oos_sharpe")).alias("overfit_warning")
    return _rounded(out, "combo_idx", "symbol", more=(*_ratios("oos_sharpe"), *_r("oos_max_drawdown", digits=9), warned))
