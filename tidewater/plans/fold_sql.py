"""The engine's fold of one-asset runs as recursive SQL, to hold the engine against."""

from __future__ import annotations

from tidewater.operators.engine import Config


def fold_sql(rows: str, keys: str, config: Config) -> dict[str, str]:
    """Common table expressions that fold ``rows`` (``keys``, ``row_idx`` from 0, ``ts, close, volume, bid, ask, target``): ``folded`` has a row a
    row with what happened in it, ``logged`` the ledger. Latency in steps, child orders, capacity, fixed or no slippage, commission, borrow
    cost, leverage, position, cash and drawdown limits and margin are told; names of further settings of ``config`` must be at their defaults."""
    c = config
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM r.{k}" for k in keys.split(", "))
    bps = c.slippage_bps if c.slippage_model == "fixed" else 0.0
    market = "CASE WHEN pr1 > 0 THEN ask ELSE bid END" if c.use_bid_ask_execution else "close"
    child = f", {c.child_order_size}" if c.child_order_size > 0 else ""
    least = -c.max_position if c.allow_short else 0
    margin = f"abs(position * close) > {c.margin_limit!r}" if c.margin_limit > 0 else "false"
    entry = lambda when, type_, order="0", parent="0", qty="0", price="0.0", cash="cash0", equity="0.0": (
        f"CASE WHEN {when} THEN {{'type': '{type_}', 'order_id': ({order})::BIGINT, 'parent_order_id': ({parent})::BIGINT, 'quantity': ({qty})::BIGINT, 'price': ({price})::DOUBLE, 'cash_after': {cash}, 'equity': ({equity})::DOUBLE}} END"
    )
    entries = ", ".join(
        [
            entry("levrej", "ORDER_REJECTED_LEVERAGE", qty="gap"),
            entry("limrej", "ORDER_REJECTED_LIMIT", qty="target"),
            entry("cancel", "ORDER_CANCELLED_REPLACE", parent="pid"),
            entry("submit", "ORDER_SUBMITTED", parent="pid1", qty="gap"),
            entry("waits", "ORDER_WAITING_QUEUE", parent="pid1"),
            entry("fillq <> 0", "FILL_APPLIED", "nc", "pid1", "fillq", "price"),
            entry("cashrej", "ORDER_REJECTED_CASH", parent="pid1", qty="fillq", price="price"),
            entry("kill1", "RISK_KILL_SWITCH", cash="cash1", equity="cash1 + position * close"),
            entry("kill2", "RISK_KILL_SWITCH", cash="cash", equity="equity"),
        ]
    )
    folded = f"""SELECT DISTINCT {keys}, -1::BIGINT AS row_idx, 0::BIGINT AS ts, 0.0::DOUBLE AS close, {c.starting_cash!r}::DOUBLE AS cash, 0::BIGINT AS position, NULL::BIGINT AS pt, NULL::BIGINT AS pr, 0::BIGINT AS ready,
 0::BIGINT AS pid, 1::BIGINT AS np, 1000000::BIGINT AS nc, false AS halted, {c.starting_cash!r}::DOUBLE AS peak, 0.0::DOUBLE AS equity, 0.0::DOUBLE AS drawdown, 0::BIGINT AS trade, 0::BIGINT AS fillq, 0.0::DOUBLE AS price, 0.0::DOUBLE AS fee, 0::BIGINT AS filled_parent,
 0::BIGINT AS held, false AS liquidated, []::STRUCT("type" VARCHAR, order_id BIGINT, parent_order_id BIGINT, quantity BIGINT, price DOUBLE, cash_after DOUBLE, equity DOUBLE)[] AS entries FROM {rows}
UNION ALL
SELECT {keys}, row_idx, ts, close, CASE WHEN liquidated THEN cash + position * close ELSE cash END, CASE WHEN liquidated THEN 0 ELSE position END, CASE WHEN kill2 THEN NULL ELSE pt2 END, pr2, ready2, pid1, np1,
 nc + (fillq <> 0)::INT, halted1 OR kill2, peak2, equity, fallen, position - position0, fillq, price, fee, CASE WHEN fillq <> 0 THEN pid1 END, position, liquidated, list_filter([{entries}], lambda x: x IS NOT NULL) FROM (
 SELECT *, NOT halted1 AND fallen > {c.max_drawdown_pct!r} AS kill2 FROM (
 SELECT *, CASE WHEN peak2 > 0 THEN (peak2 - equity) / peak2 ELSE 0 END AS fallen, {margin} AS liquidated FROM (
 SELECT *, halted OR kill1 AS halted1, CASE WHEN kill1 OR cashrej THEN NULL WHEN applied AND (pr2 = 0 OR position = pt1) THEN NULL ELSE pt1 END AS pt2, CASE WHEN applied THEN row_idx + {c.child_slice_delay_steps + 1} ELSE ready1 END AS ready2,
  cash1 + position * close AS equity, greatest(peak1, cash1 + position * close) AS peak2, cash1 AS cash FROM (
 SELECT *, applied AND (peak1 - (cash1 + position * close)) / peak1 > {c.max_drawdown_pct!r} AS kill1 FROM (
 SELECT *, CASE WHEN applied THEN greatest(peak, cash1 + position * close) ELSE peak END AS peak1 FROM (
 SELECT * EXCLUDE (position), position AS position0, CASE WHEN applied THEN cash_try ELSE cash0 END AS cash1, position + CASE WHEN applied THEN fillq ELSE 0 END AS position, pr1 - CASE WHEN applied THEN fillq ELSE 0 END AS pr2 FROM (
 SELECT *, fillq <> 0 AND NOT cashrej AS applied FROM (
 SELECT *, fillq > 0 AND cash_try < 0 AND position >= 0 AS cashrej FROM (
 SELECT *, cash0 - fillq * price - fee AS cash_try FROM (
 SELECT *, abs(fillq) * price * {c.commission_bps!r} * 1e-4 AS fee FROM (
 SELECT *, {market} * (1.0 + sign(fillq) * {bps!r} * 1e-4) AS price FROM (
 SELECT *, due AND most <= 0 AS waits, CASE WHEN due AND most > 0 THEN sign(pr1)::BIGINT * least(abs(pr1), most{child}) ELSE 0 END AS fillq FROM (
 SELECT *, NOT halted AND pt1 IS NOT NULL AND ready1 <= row_idx AS due, CASE WHEN volume >= 1 THEN floor(least(volume * {c.max_participation_rate!r}, volume))::BIGINT ELSE 0 END AS most FROM (
 SELECT *, CASE WHEN submit THEN wanted WHEN ok AND NOT same THEN NULL ELSE pt END AS pt1, CASE WHEN submit THEN gap ELSE pr END AS pr1, CASE WHEN submit THEN row_idx + {max(0, c.latency_steps)} ELSE ready END AS ready1,
  CASE WHEN submit THEN np ELSE pid END AS pid1, np + submit::INT AS np1 FROM (
 SELECT *, ok AND wanted <> target AS limrej, ok AND NOT same AND pt IS NOT NULL AS cancel, ok AND NOT same AND gap <> 0 AS submit FROM (
 SELECT *, NOT halted AND abs(wanted * close) / greatest(1.0, cash0) > {c.max_gross_leverage!r} AS levrej, NOT halted AND abs(wanted * close) / greatest(1.0, cash0) <= {c.max_gross_leverage!r} AS ok,
  coalesce(pt = wanted, false) AS same, wanted - position AS gap FROM (
 SELECT {", ".join("r." + k for k in keys.split(", "))}, r.row_idx, r.ts, r.close, r.volume, r.bid, r.ask, r.target, s.cash - CASE WHEN s.position < 0 THEN -s.position * r.close * {c.annual_borrow_bps * 1e-4 / 252.0!r} ELSE 0 END AS cash0,
  least(greatest(r.target, {least}), {c.max_position}) AS wanted, s.position, s.pt, s.pr, s.ready, s.pid, s.np, s.nc, s.halted, s.peak FROM folded s JOIN {rows} r ON {on} AND r.row_idx = s.row_idx + 1"""
    folded += ")" * folded.count("FROM (\n")
    logged = f"""SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY row_idx, k) AS sequence, ts, e.order_id, e.parent_order_id, e.type, e.quantity, e.price, e.cash_after,
 CASE WHEN k = n THEN held ELSE e.equity END AS equity_after FROM (
 SELECT p.*, q.equity AS held, unnest(p.entries) AS e, unnest(range(1, p.n + 1)) AS k FROM (
  SELECT {keys}, row_idx, ts, entries, len(entries) AS n, coalesce(lead(row_idx) OVER (PARTITION BY {keys} ORDER BY row_idx), last_row + 1) - 1 AS until FROM
   (SELECT *, max(row_idx) OVER (PARTITION BY {keys}) AS last_row FROM folded) WHERE len(entries) > 0) p
 JOIN folded q ON {" AND ".join(f"p.{k} IS NOT DISTINCT FROM q.{k}" for k in keys.split(", "))} AND q.row_idx = p.until)"""
    return {"folded": folded, "logged": logged}


def portfolio_sql(rows: str, assets: int, config: Config) -> list[str]:
    """Common table expressions that fold ``rows`` (``symbol, ts, close, volume, target``) as portfolios of ``assets`` symbols that share cash: ``folded_shared``
    has a row for every bar, in order of time and symbol, and what the portfolio is after it; ``last`` tells the last of a time. Settings beyond
    costs, capacity and the limits on position, leverage, cash and drawdown must be at their defaults."""
    c = config
    each = lambda what, over="range(1, len(cl) + 1)": f"list_transform({over}, lambda i: {what})"
    worth = lambda position: f"coalesce(list_sum({each(f'{position} * cl[i]')}), 0)"
    put = lambda name, value: each(f"CASE WHEN i = k THEN {value} ELSE {name}[i] END")
    wished = "wanted[i] <> pos[i]"
    after = "(held - abs(pos[i]) * cl[i] + abs(wanted[i]) * cl[i]) / base"
    fresh = f"here[i] AND NOT coalesce(pt[i] = wanted[i], false) AND {wished} AND {after} <= {c.max_gross_leverage!r}"
    kept = f"NOT here[i] OR coalesce(pt[i] = wanted[i], false) OR ({wished} AND {after} > {c.max_gross_leverage!r})"
    return [
        f"dn AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS a FROM (SELECT DISTINCT symbol FROM {rows}))",
        f"cells AS (SELECT (a // {assets})::INT AS portfolio, (a % {assets} + 1)::INT AS k, ts, close, volume, target FROM {rows} JOIN dn USING (symbol))",
        "times AS (SELECT portfolio, ts, row_number() OVER (PARTITION BY portfolio ORDER BY ts) - 1 AS r FROM (SELECT DISTINCT portfolio, ts FROM cells))",
        """dense AS (SELECT t.portfolio, t.r, s.k, c.close IS NOT NULL AS here, coalesce(last_value(c.close IGNORE NULLS) OVER w, 0) AS close, coalesce(last_value(c.target IGNORE NULLS) OVER w, 0) AS target
 FROM times t JOIN (SELECT DISTINCT portfolio, k FROM cells) s ON s.portfolio = t.portfolio LEFT JOIN cells c ON c.portfolio = t.portfolio AND c.ts = t.ts AND c.k = s.k
 WINDOW w AS (PARTITION BY t.portfolio, s.k ORDER BY t.r ROWS UNBOUNDED PRECEDING))""",
        "wide AS (SELECT portfolio, r, list(close ORDER BY k) AS cl, list(target ORDER BY k) AS tg, list(here ORDER BY k) AS here FROM dense GROUP BY ALL)",
        """parts AS MATERIALIZED (SELECT c.portfolio, t.r, c.ts, c.k, c.close, c.volume, w.cl, w.tg, w.here, row_number() OVER (PARTITION BY c.portfolio ORDER BY t.r, c.k) AS n,
 c.k = min(c.k) OVER (PARTITION BY c.portfolio, t.r) AS first, c.k = max(c.k) OVER (PARTITION BY c.portfolio, t.r) AS last
 FROM cells c JOIN times t ON t.portfolio = c.portfolio AND t.ts = c.ts JOIN wide w ON w.portfolio = t.portfolio AND w.r = t.r)""",
        f"""folded_shared AS (SELECT portfolio, 0::BIGINT AS n, -1::BIGINT AS r, 0::BIGINT AS ts, false AS last, {c.starting_cash!r}::DOUBLE AS cash, 0.0::DOUBLE AS base, list_transform(range(len(cl)), lambda i: 0::BIGINT) AS pos,
 list_transform(range(len(cl)), lambda i: NULL::BIGINT) AS pt, list_transform(range(len(cl)), lambda i: 0::BIGINT) AS pr, {c.starting_cash!r}::DOUBLE AS peak, false AS halted, 0.0::DOUBLE AS equity, 0.0::DOUBLE AS drawdown, 0::BIGINT AS fills, 0::BIGINT AS pos0 FROM wide WHERE r = 0
UNION ALL
SELECT portfolio, n, r, ts, last, cash1, base, pos1, CASE WHEN halted2 THEN {each("NULL::BIGINT")} ELSE pt2 END, pr2, peak2, halted2, equity, fallen, fills1, pos0 FROM (
 SELECT *, halted1 OR (last AND fallen > {c.max_drawdown_pct!r}) AS halted2 FROM (
 SELECT *, CASE WHEN peak2 > 0 THEN (peak2 - equity) / peak2 ELSE 0 END AS fallen FROM (
 SELECT *, CASE WHEN applied OR last THEN greatest(peak, equity) ELSE peak END AS peak2, halted OR (applied AND (greatest(peak, equity) - equity) / greatest(peak, equity) > {c.max_drawdown_pct!r}) AS halted1,
  {put("pt1", "CASE WHEN cashrej OR (applied AND (pr1[k] = fillq OR pos1[k] = pt1[k])) THEN NULL ELSE pt1[k] END")} AS pt2, {put("pr1", "CASE WHEN applied THEN pr1[k] - fillq ELSE pr1[k] END")} AS pr2 FROM (
 SELECT *, cash1 + {worth("pos1[i]")} AS equity FROM (
 SELECT *, CASE WHEN applied THEN cash_try ELSE cash END AS cash1, {put("pos", "pos[k] + CASE WHEN applied THEN fillq ELSE 0 END")} AS pos1, CASE WHEN first THEN 0 ELSE fills END + (fillq <> 0)::INT AS fills1 FROM (
 SELECT *, fillq <> 0 AND NOT cashrej AS applied FROM (
 SELECT *, fillq > 0 AND cash_try < 0 AND pos[k] >= 0 AS cashrej FROM (
 SELECT *, cash - fillq * price - abs(fillq) * price * {c.commission_bps!r} * 1e-4 AS cash_try FROM (
 SELECT *, close * (1.0 + sign(fillq) * {c.slippage_bps!r} * 1e-4) AS price FROM (
 SELECT *, CASE WHEN NOT halted AND pt1[k] IS NOT NULL AND volume >= 1 THEN sign(pr1[k])::BIGINT * least(abs(pr1[k]), floor(least(volume * {c.max_participation_rate!r}, volume))::BIGINT) ELSE 0 END AS fillq FROM (
 SELECT *, CASE WHEN places THEN {each(f"CASE WHEN {fresh} THEN wanted[i] WHEN {kept} THEN pt[i] END")} ELSE pt END AS pt1, CASE WHEN places THEN {each(f"CASE WHEN {fresh} THEN wanted[i] - pos[i] ELSE pr[i] END")} ELSE pr END AS pr1 FROM (
 SELECT *, first AND NOT halted AND {worth("abs(wanted[i])")} / base <= {c.max_gross_leverage!r} AS places, {worth("abs(pos[i])")} AS held FROM (
 SELECT p.*, s.cash, CASE WHEN p.first THEN greatest(1.0, s.cash) ELSE s.base END AS base, s.pos, s.pt, s.pr, s.peak, s.halted, s.fills, CASE WHEN p.first THEN list_sum(s.pos)::BIGINT ELSE s.pos0 END AS pos0,
  list_transform(p.tg, lambda t: least(greatest(t, {-c.max_position}), {c.max_position})) AS wanted FROM folded_shared s JOIN parts p ON p.portfolio = s.portfolio AND p.n = s.n + 1
 ))))))))))))))""",
    ]
