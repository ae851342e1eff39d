"""Spam pages: features, scores and held-out agreement with the raters."""

import numpy as np
import pytest

from tidewater.llm.pagefeatures import FEATURES, content_sentences, features, mend
from tidewater.llm.spam import DEFAULT_CUT, fitted_cut, page_features, spam_pages

PROSE = "The notes describe how the old ferry was late on Tuesday. Nobody asked why it had been so, and there is little doubt that some of them knew. "
LIST = "cheap flights, buy wigs, loans online, best flights, wigs discount, no deposit loans, watches near me, top rated wigs, "
STUFFED = "Looking for wigs? These wigs are cheap wigs for everyone who wants wigs. Our wigs are the best wigs because wigs beat all other wigs. "
DOCS = "doc_id bigint, text string, language string, score double"


def value(text, name):
    return features(text)[2][FEATURES.index(name)]


def test_features_tell_sentences_from_lists():
    assert value(PROSE * 3, "loose") < 0.1 < 0.8 < value(LIST * 4, "loose")
    assert value(PROSE * 3, "focus") < 0.2 < value(STUFFED * 4, "focus")
    assert value("#redshoes #blueshoes #cheapwigs #buywigs #loansnow " * 4, "tags") > 0.5
    assert value("c h e a p   f l i g h t s\nb u y   w i g s   n o w " * 5, "hidden") > 0.3
    assert value("r3d $h0e$ ch3ap w1g$ b3$t l0an$ " * 6, "hidden") > 0.3
    table = "\n".join(f"Station{i} 05:1{i} 06:2{i} 07:3{i}" for i in range(9))
    assert value(PROSE + "\n" + table, "loose") < 0.1  # a timetable is data to be read
    assert features("Крепкий чай был на столе, и никто не знал, почему он там. " * 3)[0] == "ru"
    assert features("天気はとても静かだが、港の指数はそうではない。" * 4)[0] == "ja"


@pytest.mark.parametrize("charset", ["cp1252", "cp1251", "latin-1", "koi8-r"])
def test_wrong_charsets_are_mended(charset):
    text = "Près de 42 visiteurs étaient là, où personne ne s'inquiète à l'époque des congés. "
    garbled = text.encode("utf-8").decode(charset, "replace")
    assert "visiteurs" in mend(garbled) and (mend(garbled) == text or charset == "cp1251")
    assert mend(text) == text and mend("Никто не знает, почему.") == "Никто не знает, почему."


def test_menus_and_notices_are_left_aside():
    text = "Home | News | Help | Login\nWe use cookies to make this site work. Accept all | Settings | Reject\nThe ferry was late.\nAll rights reserved. Terms of use | Privacy"
    assert content_sentences(text) == ["The ferry was late."]


@pytest.mark.parametrize("notice", ["All rights reserved.", "Subscribe to our newsletter and never miss an update.", "This website stores small files on your device.", "We and our 9 partners store and access information on your device."])
def test_a_notice_in_one_line_with_content_leaves_the_content(notice):
    tags = " ".join(f"#cheap{w}" for w in ("wigs", "tyres", "loans", "watches", "flights")) * 8
    for content in (LIST * 12, tags):
        own = features(content)
        language, words, values = features(f"{content.strip()} {notice}")
        assert abs(words - own[1]) <= 2 and np.allclose(values, own[2], atol=0.05)
    assert content_sentences("Home | News | Help | Login " + notice) == []
    assert content_sentences("All rights reserved " + "cheap wigs for sale " * 9) == [("cheap wigs for sale " * 9).strip()]


def rows():
    rng = np.random.default_rng(3)
    nouns = [f"word{i}" for i in range(300)]
    sentence = lambda: "The " + " ".join(rng.choice(nouns, 3)) + " was in the " + " ".join(rng.choice(nouns, 3)) + " before it. "
    out = [(i, "".join(sentence() for _ in range(int(rng.integers(3, 30)))), "x", 1.0) for i in range(300)]
    out += [(1_000 + i, (LIST if i % 2 else STUFFED) * int(rng.integers(3, 12)), "x", 1.0) for i in range(20)]
    return out + [(2_000, None, "x", 1.0), (2_001, "", "x", 1.0), (2_002, "Error", "x", 1.0), (2_003, "wigs " * 200_000, "x", 1.0), (0, out[0][1], "x", 1.0), (None, PROSE, "x", 1.0)]


def test_spam_pages(spark):
    pages = spam_pages(spark.createDataFrame(rows(), DOCS).repartition(3)).toPandas()
    assert len(pages) == len(rows())
    assert set(pages[pages.is_spam].doc_id) == {1_000 + i for i in range(20)} | {2_003}
    assert spam_pages(spark.createDataFrame([], DOCS)).count() == 0


def test_cut_follows_the_raters_within_its_bounds(spark):
    scores = spark.createDataFrame([(i, float(i) / 10) for i in range(100)], "doc_id bigint, score double")
    labels = spark.createDataFrame([(i, "spam" if i > 55 else "ok") for i in range(100)] + [(3, "unsure"), (None, "spam")], "doc_id bigint, label string")
    assert 5.25 <= fitted_cut(scores, labels) <= 5.75
    assert fitted_cut(scores, labels.where("label = 'ok'")) == DEFAULT_CUT


def test_held_out_raters(spark, small_root):
    root = small_root.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{root}/page_labels.parquet")
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1 and label != 'unsure'")
    documents = spark.read.parquet(f"{root}/documents.parquet")
    judged = spam_pages(documents, fit).join(held, "doc_id").select("is_spam", "label").toPandas()
    says = judged.label == "spam"
    assert (judged.is_spam == says).mean() > 0.90  # about a page in fourteen is rated wrongly
    assert says[judged.is_spam].mean() > 0.75
    assert page_features(documents.limit(3)).count() == 3
