"""Containers: invariants, bounds and awkward rows."""

import numpy as np
import pandas as pd
import pytest

from tidewater.llm.packing import Windows, container_summary, pack_documents
from tidewater.llm.tokens import encoding, token_counts

DOCS = "doc_id bigint, text string, container_id string, tokens int"


def documents(n=400, seed=0):
    rng = np.random.default_rng(seed)
    words = "the harbour index was steady before a late dividend and nobody asked why".split()
    rows = [(i, " ".join(rng.choice(words, int(rng.lognormal(4, 1)))), "x", 1) for i in range(n)]
    return rows + [(n, None, "x", 1), (n + 1, "", "x", 1), (None, "no id", "x", 1), (5, rows[5][1], "x", 1), (n + 2, "steady " * 5_000, "x", 1)]


@pytest.mark.parametrize("parts", [1, 7])
def test_every_token_has_one_place(spark, parts):
    rows = documents()
    packed = pack_documents(spark.createDataFrame(rows, DOCS).repartition(parts), capacity=256, most_open=8, merged_partitions=3)
    out = packed.toPandas()
    sizes = pd.Series(token_counts([r[1] for r in rows]))
    assert out["tokens"].sum() == sizes.sum()
    fills = out.groupby("container_id")["tokens"].sum()
    assert fills.max() <= 256
    assert (out.groupby("container_id")["container_fill"].nunique() == 1).all()
    assert (fills == out.groupby("container_id")["container_fill"].first()).all()
    by_doc = out.dropna(subset=["doc_id"]).groupby("doc_id")
    assert set(by_doc.groups) == {r[0] for r in rows if r[0] is not None} and out["doc_id"].isna().sum() == 1
    assert len(by_doc.get_group(5)) == 2  # the repeated row has its own place
    split = out[out.n_pieces > 1]
    assert set(split["doc_id"]) == {r[0] for r, s in zip(rows, sizes) if s > 256}
    whole = split[split.piece_no < split.n_pieces - 1]
    assert (whole["tokens"] == 256).all()
    assert len(fills) <= 1.12 * np.ceil(sizes.sum() / 256) + parts
    assert container_summary(packed, 256).toPandas()["containers"].sum() == len(fills)


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_windows_take_the_best_fit_and_close_the_fullest():
    w = Windows(10, 2)
    assert w.place(6, "a") == [] and w.place(7, "b") == []
    assert w.place(3, "c") == [(1, 10, ["b", "c"])]
    assert w.place(9, "d") == [] and w.place(8, "e") == [(1 + 1, 9, ["d"])]
    assert sorted(x[2][0] for x in w.rest()) == ["a", "e"]


def test_tokens_round_trip():
    text = "Überzeugt, près de 42 гостей <|endoftext|> 天気"
    e = encoding()
    assert e.decode(e.encode_ordinary(text)) == text and token_counts([text, None, ""])[1:] == [0, 0]
