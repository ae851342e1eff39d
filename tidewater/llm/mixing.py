"""Sources mixed to target shares of all tokens, by raking and calibrated sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.pagekind import page_kind
from tidewater.llm.tokens import VOCABULARY, token_counts
from tidewater.runtime import cut_lineage

#: Rounds of raking, and the steps of the hash at which a source's sampling threshold is set.
ROUNDS, STEPS = 50, 1 << 14
#: Cells (source times language times topic) up to which the rates are broadcast; beyond it they are joined by a shuffle.
BROADCAST_CELLS = 100_000
MARGINS = ("source", "language", "topic")


def sized_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, language, topic, tokens, u`` of every document: its cell, its size and a uniform hash.

    Language and topic are told from the text (``pagekind``), as declared languages may be wrong.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds = [page_kind(t) for t in pdf["text"]]
            out = pdf[["doc_id", "source"]].assign(language=[k[0] for k in kinds], topic=[k[1] for k in kinds])
            yield out.assign(tokens=token_counts(pdf["text"], vocabulary))

    cells = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    sized = cells.mapInPandas(count, "doc_id bigint, source string, language string, topic string, tokens bigint")
    u = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return sized.withColumn("u", u)


def rake(cells: pd.DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, rounds: int = ROUNDS) -> pd.DataFrame:
    """Tokens to ``take`` of every cell and those ``wanted`` of its source, by iterative proportional fitting under caps.

    cells: ``source, language, topic, tokens``; targets: share and most repeats by source. The margins are the sources'
    target shares (of the sources that have tokens, scaled to one) and the languages' and topics' own shares of the
    tokens. A cell is never taken more than its source's repeats allow. The source margins come last in every round and
    are met exactly, what a capped cell can't give being given by the source's other cells. Without ``total`` the mix is
    as large as the scarcest source permits; with it a source that can't give its share gives all it can, and the rest is its shortfall.
    """
    cells = cells[cells["tokens"] > 0].reset_index(drop=True)
    present = [s for s in targets if targets[s][0] > 0 and targets[s][1] > 0 and (cells["source"] == s).any()]
    cells = cells[cells["source"].isin(present)].reset_index(drop=True)
    if not len(cells):
        return cells.assign(take=pd.Series(dtype=float), wanted=pd.Series(dtype=float))
    have = cells.groupby("source")["tokens"].sum()
    whole = sum(targets[s][0] for s in present)
    share = {s: targets[s][0] / whole for s in present}
    size = float(total) if total is not None else min(have[s] * targets[s][1] / share[s] for s in present)
    base = cells["tokens"].to_numpy(float)
    cap = base * cells["source"].map(lambda s: targets[s][1]).to_numpy(float)
    take = np.minimum(cap, base * size / base.sum())
    margins = []
    for column in MARGINS[1:]:
        codes, _ = pd.factorize(cells[column])
        margins.append((codes, np.bincount(codes, base) / base.sum() * size))
    codes, names = pd.factorize(cells["source"])
    asked = np.array([share[s] * size for s in names])
    wanted = np.minimum(asked, np.bincount(codes, cap))
    for _ in range(rounds):
        before = take
        for at, goal in margins:
            sums = np.bincount(at, take)
            take = np.minimum(cap, take * np.where(sums > 0, goal / np.maximum(sums, 1e-300), 1.0)[at])
        for _ in range(len(cells) + 1):
            full = take >= cap * (1 - 1e-12)
            kept, free = np.bincount(codes, take * full), np.bincount(codes, take * ~full)
            factor = np.where(free > 0, (wanted - kept) / np.maximum(free, 1e-300), 1.0)
            shrink = kept > wanted
            factor_full = np.where(shrink, wanted / np.maximum(kept + free, 1e-300), 1.0)
            grown = np.where(shrink[codes], take * factor_full[codes], np.where(full, take, take * np.maximum(factor, 0)[codes]))
            over = grown > cap
            take = np.minimum(grown, cap)
            if not over.any():
                break
        if np.abs(take - before).max() <= 1e-9 * size:
            break
    return cells.assign(take=take, wanted=asked[codes])


def mix_documents(documents: DataFrame, mix_targets: DataFrame, *, total: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents of the mix: ``doc_id, source, language, topic, tokens, repeats``.

    Token totals per cell (source, language, topic) are raked to the targets on the driver; cells are as many as the
    targets' sources times the known languages and topics. A cell's expected copies of each
    document are its tokens to take over its tokens; the whole part is taken outright, the rest by comparing a hash of
    the document with a threshold that is calibrated per source on the histogram of all documents' hashes, so that the
    tokens drawn meet the source's target to a document or a 16,384th. Histogram and thresholds stay in the cluster. No document is
    used more than its source's ``max_repeats``. Documents without a source, with a source that has no target, or without tokens
    are not used; targets with null or non-positive share or repeats count as absent, of repeated sources the largest share holds.
    Sources without documents are left out and the other shares scaled up. Without ``total`` the mix is the largest that meets all
    shares; with it a source that is too small gives all it can (``mix_shares`` reports the shortfall). An empty table gives no rows.
    """
    sized = cut_lineage(sized_documents(documents, vocabulary))
    return _mixed(sized, _raked(sized, mix_targets, total))


def _targets(mix_targets: DataFrame) -> dict[str, tuple[float, int]]:
    """The usable targets, a dimension that somebody wrote down: a row a source."""
    rows = (
        mix_targets.where("source is not null and target_share > 0 and max_repeats > 0 and not isnan(target_share)")
        .groupBy("source")
        .agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
        .collect()
    )
    return {r["source"]: (float(r["t"]["target_share"]), int(r["t"]["max_repeats"])) for r in rows}


def _raked(sized: DataFrame, mix_targets: DataFrame, total: float | None) -> pd.DataFrame:
    """The cells of the targets' sources with the tokens to take, wanted and capped."""
    targets = _targets(mix_targets)
    known = sized.sparkSession.createDataFrame([(s,) for s in targets], "source string")
    usable = sized.where(F.col("tokens") > 0).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")).join(known, "source", "left_semi")
    cells = pd.DataFrame([r.asDict() for r in usable.collect()], columns=[*MARGINS, "tokens"])
    out = rake(cells, targets, total)
    return out.assign(most=out["source"].map(lambda s: targets[s][1]) if len(out) else pd.Series(dtype=int))


def _mixed(sized: DataFrame, cells: pd.DataFrame) -> DataFrame:
    spark = sized.sparkSession
    copies = cells["take"].to_numpy(float) / np.maximum(cells["tokens"].to_numpy(float), 1.0)
    whole = np.minimum(np.floor(copies + 1e-9), cells["most"].to_numpy(float))
    part = np.clip(copies - whole, 0.0, 1.0)
    rates = cells[list(MARGINS)].assign(whole=whole.astype(int), part=part, most=cells["most"], to_take=cells["take"])
    rates = spark.createDataFrame([tuple(r) for r in rates.itertuples(index=False)], "source string, language string, topic string, whole int, part double, most int, to_take double")
    totals = rates.groupBy("source").agg(F.sum("to_take").alias("to_take"))
    rates = rates.drop("to_take")
    drawn = sized.where("tokens > 0").join(F.broadcast(rates) if len(cells) <= BROADCAST_CELLS else rates, list(MARGINS))
    drawn = drawn.withColumn("step", F.when(F.col("whole") < F.col("most"), F.floor((F.col("u") - F.col("part")) * STEPS).cast("int")))
    ladder = drawn.groupBy("source", "step").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("whole")).alias("outright"))
    # at most 2 * STEPS + 1 rungs a source
    rungs = ladder.withColumn("outright", F.sum("outright").over(Window.partitionBy("source"))).where("step is not null")
    upwards = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rungs = rungs.join(totals, "source").withColumn("lacking", F.col("to_take") - F.col("outright")).withColumn("away", F.abs(F.sum("tokens").over(upwards) - F.col("lacking")))
    cuts = rungs.groupBy("source").agg(F.min(F.struct("away", "step")).alias("best"), F.first("lacking").alias("lacking"))
    cuts = cuts.select("source", F.when(F.col("best.away") <= F.abs("lacking"), F.col("best.step")).alias("cut"))
    repeats = F.col("whole") + F.coalesce(F.col("step") <= F.col("cut"), F.lit(False)).cast("int")
    return (
        drawn.join(F.broadcast(cuts) if len(cells) <= BROADCAST_CELLS else cuts, "source", "left")
        .withColumn("repeats", repeats.cast("int"))
        .where("repeats > 0")
        .select("doc_id", "source", "language", "topic", "tokens", "repeats")
    )


def mix_shares(documents: DataFrame, mix_targets: DataFrame, *, total: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The shares really reached, a row a target: ``source, target_share, actual_share, tokens, wanted_tokens, shortfall_tokens, documents,
    most_used, max_repeats``. ``wanted_tokens`` is null for sources without documents, whose share goes to the others."""
    sized = cut_lineage(sized_documents(documents, vocabulary))
    cells = _raked(sized, mix_targets, total)
    wanted = sized.sparkSession.createDataFrame([(s, float(w)) for s, w in cells.groupby("source")["wanted"].first().items()], "source string, wanted_tokens double")
    used = _mixed(sized, cells).groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"),
        F.count(F.lit(1)).alias("documents"),
        F.max("repeats").alias("most_used"),
    )
    everything = Window.partitionBy(F.lit(1))  # over one row a source
    return (
        mix_targets.select("source", "target_share", "max_repeats").join(used, "source", "left").join(wanted, "source", "left")
        .withColumn("all_tokens", F.sum("tokens").over(everything))
        .select(
            "source",
            "target_share",
            F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            "wanted_tokens",
            F.greatest(F.col("wanted_tokens") - F.coalesce("tokens", F.lit(0)), F.lit(0.0)).alias("shortfall_tokens"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("most_used", F.lit(0)).alias("most_used"),
            "max_repeats",
        )
    )


def mix_margins(documents: DataFrame, mix_targets: DataFrame, *, total: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every margin of the mix against what raking aimed at: ``margin, value, aimed_share, actual_share, tokens``. A source's aim is its
    target share among the sources present, that of a language or topic its share of those sources' tokens."""
    sized = cut_lineage(sized_documents(documents, vocabulary))
    cells = _raked(sized, mix_targets, total)
    aims = []
    for margin in MARGINS:
        by = cells.groupby("source")["wanted"].first() if margin == "source" else cells.groupby(margin)["tokens"].sum()
        aims += [(margin, value, float(x / by.sum())) for value, x in by.items()]
    aimed = sized.sparkSession.createDataFrame(aims, "margin string, value string, aimed_share double")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("margin"), F.col(m).alias("value")) for m in MARGINS)))
    used = _mixed(sized, cells).select(each.alias("m"), (F.col("tokens") * F.col("repeats")).alias("n")).groupBy("m.margin", "m.value").agg(F.sum("n").alias("tokens"))
    of_margin = Window.partitionBy("margin")  # a row a source, language or topic
    out = aimed.join(used, ["margin", "value"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return out.withColumn("actual_share", F.coalesce(F.try_divide("tokens", F.sum("tokens").over(of_margin)), F.lit(0.0))).select("margin", "value", "aimed_share", "actual_share", "tokens")
