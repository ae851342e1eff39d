"""Mixing: shares, caps and awkward targets."""

import numpy as np
import pandas as pd

from tidewater.llm.mixing import mix_documents, mix_margins, mix_shares, rake
from tidewater.llm.pagekind import page_kind

DOCS = "doc_id bigint, source string, lang string, host string, text string, take double, step int"
TARGETS = "source string, target_share double, max_repeats int"


def documents(spark, n=3_000):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        source = str(rng.choice(["big", "mid", "small"], p=[0.8, 0.15, 0.05]))
        rows.append((i, source, str(rng.choice(["en", "de", "xx"])), str(rng.choice(["www.a.example", "blog.b.example", "z"])), "steady " * int(rng.integers(5, 60)), 1.0, 1))
    rows += [(n, None, "en", "www.a.example", "no source", 1.0, 1), (n + 1, "big", None, None, None, 1.0, 1), (n + 2, "big", None, None, "", 1.0, 1), (n + 3, "other", "en", "z", "no target", 1.0, 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_shares_and_caps_are_met(spark):
    docs = documents(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("absent", 0.05, 3), (None, 0.1, 1), ("bad", None, 1)], TARGETS)
    mix = mix_documents(docs, targets).toPandas()
    caps = {"big": 1, "mid": 2, "small": 4}
    used = (mix.tokens * mix.repeats).groupby(mix.source).sum()
    share = used / used.sum()
    for source, target in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert abs(share[source] - target / 0.95) < 0.005
        assert mix[mix.source == source].repeats.max() <= caps[source]
    assert mix.doc_id.is_unique and set(mix.source) == set(caps)
    tokens = docs.where("source = 'small'").count()
    assert (mix.source == "small").sum() == tokens  # every small document is needed
    shares = mix_shares(docs, targets).toPandas().set_index("source")
    assert abs(shares.actual_share[["big", "mid", "small"]].sum() - 1) < 1e-9 and shares.actual_share["absent"] == 0
    half = mix_documents(docs, targets, total=used.sum() / 2).toPandas()
    assert abs((half.tokens * half.repeats).sum() / (used.sum() / 2) - 1) < 0.01
    more = mix_shares(docs, targets, total=used.sum() * 1.2).toPandas().set_index("source")  # more than the scarcest source can give
    assert abs(more.shortfall_tokens["mid"] / (0.2 * used["mid"]) - 1) < 0.01 and more.shortfall_tokens["big"] < 60
    assert abs(more.tokens["small"] / (used["small"] * 1.2) - 1) < 0.01 and np.isnan(more.wanted_tokens["absent"])
    margins = mix_margins(docs, targets).toPandas()
    assert np.allclose(margins.groupby("margin")[["aimed_share", "actual_share"]].sum(), 1.0)
    assert (margins[margins.margin == "source"].eval("abs(aimed_share - actual_share)") < 0.005).all()


def test_no_documents_or_no_targets(spark):
    docs = documents(spark, 50)
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    assert mix_documents(docs.limit(0), targets).count() == 0
    assert mix_documents(docs, targets.limit(0)).count() == 0
    assert mix_documents(docs, targets).where("source != 'big'").count() == 0


def test_raking_keeps_caps_and_source_margins():
    rng = np.random.default_rng(2)
    cells = pd.DataFrame([(s, l, t, int(rng.integers(1, 1_000))) for s in "abc" for l in "xy" for t in "pq"], columns=["source", "language", "topic", "tokens"])
    targets = {"a": (0.6, 3), "b": (0.3, 1), "c": (0.1, 5)}
    out = rake(cells, targets)
    caps = out.tokens * out.source.map(lambda s: targets[s][1])
    assert (out["take"] <= caps * (1 + 1e-9)).all()
    got = out.groupby("source")["take"].sum() / out["take"].sum()
    assert all(abs(got[s] - targets[s][0]) < 1e-9 for s in targets)
    free = rake(cells.assign(tokens=cells.tokens * 1), targets, total=100.0)
    languages = free.groupby("language")["take"].sum() / free["take"].sum()
    wanted = cells.groupby("language")["tokens"].sum() / cells["tokens"].sum()
    assert np.allclose(languages, wanted, atol=0.02)


def test_kind_and_language_are_told_from_the_text():
    assert page_kind("The ferry was late and nobody knew why it had been so.") == ("en", "note")
    assert page_kind("Niemand weiß, warum das so ist. " * 40)[0] == "de" and page_kind("The ferry was late. " * 60)[1] == "article"
    assert page_kind("天気はとても静かだが、港の指数はそうではない。")[0] == "ja"
    assert page_kind("\n".join(f"> line {i}" for i in range(4)))[1] == "discussion"
    assert page_kind(None) == page_kind(" ") == ("other", "empty") and page_kind("xyz") == ("other", "note")
