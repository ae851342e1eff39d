"""Streams: paper trading equals the batch fold; bars from ticks; the library without its text subpackage."""

import subprocess
import sys
import uuid

from pyspark.sql import functions as F

from tidewater.operators.engine import Config
from tidewater.streaming import paper

TICKS = "src_order bigint, timestamp_ns bigint, symbol string, price double, size double, side string"


def ticks(n=60):
    rows = [(i, i * 10**9, ["AAA", "BBB"][i % 2], 100.0 + (i * 7) % 5, 500.0, ["bid", "ASK", "trade", None][i % 4]) for i in range(n)]
    return rows + [(900, 1, None, 5.0, 1.0, "bid"), (901, 2, "AAA", None, 1.0, "bid"), (902, 3, "AAA", -1.0, None, "bid")]


def drained(stream, tmp_path, mode):
    name = f"t{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_paper_stream_equals_one_session(spark, tmp_path):
    rows = ticks()
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + (20 if k < 2 else 99)], TICKS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}.parquet"))
    source = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*.parquet"))
    config = Config(max_position=2, latency_steps=1)
    out = drained(paper.paper_positions(source, config), tmp_path, "update").toPandas()
    last = out.sort_values("rows").groupby("symbol").last()
    for symbol in ("AAA", "BBB"):
        session = paper.PaperSession(config, paper.follow_trend)
        for _, ts, s, price, size, side in rows[:60]:
            if s == symbol:
                session = paper.PaperSession(config, paper.follow_trend, session.to_json())
                session.on_tick(s, ts, price, size, {"bid": "BID", "ASK": "ASK"}.get(side, "TRADE"))
        assert (last.loc[symbol, "position"], last.loc[symbol, "rows"]) == (session.state.positions[0], 30)
        assert last.loc[symbol, "cash"] == session.state.cash and last.loc[symbol, "fills"] == session.state.filled_orders > 0


def test_symbols_of_a_portfolio_share_cash(spark, tmp_path):
    rows = ticks()
    spark.createDataFrame([*rows, (950, 10**9, "BBB", 102.0, 500.0, "ASK"), (951, 7, "ZZZ", 5.0, 1.0, "bid")], TICKS).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(TICKS).parquet(str(tmp_path / "in"))
    both = spark.createDataFrame([("AAA", "P"), ("BBB", "P")], "symbol string, portfolio string")
    out = drained(paper.paper_positions(source, Config(), portfolios=both), tmp_path, "update").toPandas().set_index("symbol")
    session = paper.PaperSession(Config(), paper.follow_trend, members=frozenset(("AAA", "BBB")))
    for _, ts, s, price, size, side in rows[:60]:
        session.on_tick(s, ts, price, size, {"bid": "BID", "ASK": "ASK"}.get(side, "TRADE"))
    assert session.on_tick("ZZZ", 99, 5.0, 1.0, "BID") == [] and session.on_tick("BBB", 59 * 10**9, 1.0, 1.0, "BID") == []  # unknown, and sent twice
    assert out.position.to_dict() == dict(zip(session.symbols, session.state.positions.tolist())) and (out.cash == session.state.cash).all() and (out.rows == 60).all()
    sent = []
    found = session.reconcile({"AAA": int(session.state.positions[0]), "BBB": int(session.state.positions[1]) + 3, "CCC": 2}, lambda s, d: sent.append((s, d)))
    assert sent == [("BBB", 3.0), ("CCC", 2.0)] and {x["action"] for x in found} == {"submit_order"}


def test_bars_from_a_stream(spark, tmp_path):
    spark.createDataFrame(ticks(400), TICKS).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(TICKS).parquet(str(tmp_path / "in"))
    bars = drained(paper.streamed_bars(source), tmp_path, "complete")
    assert bars.where("symbol = 'AAA'").count() == 7 and bars.where(F.col("low") > F.col("high")).count() == 0


def test_ledger_sink_is_idempotent(spark, tmp_path):
    write = paper.ledger_sink(str(tmp_path / "out"))
    batch = spark.createDataFrame([(1, "x")], "sequence bigint, type string")
    write(batch, 0)
    write(batch, 0)
    write(batch, 1)
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_core_does_not_import_the_text_subpackage():
    code = "import sys; import tidewater.plans.catalog as c; c.queries(); assert not any(m.startswith('tidewater.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True)
