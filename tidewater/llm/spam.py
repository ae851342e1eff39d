"""Keyword-stuffed pages, link lists and product tags by robust distances in spam-directed directions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.pagefeatures import FEATURES, feature_array
from tidewater.runtime import cut_lineage

#: Words of own content at which a page's figures count in full; those of a shorter page count in proportion.
FULL_WORDS = 40
#: Pages that the figures of all languages weigh against a language's own.
PRIOR_PAGES = 100
#: Concentration steps of the robust covariance, the squared distance within which pages enter it (the 0.975 quantile of chi-square
#: with as many degrees of freedom as there are features), and the ridge that keeps it regular where features are 0 on nearly all pages.
CONCENTRATIONS, INSIDE, RIDGE = 4, 16.01, 0.25
#: Least scale of each feature, so that features which are 0 on nearly all pages don't blow up.
LEAST_SCALE = np.array([0.10, 0.15, 0.05, 0.20, 0.03, 0.03, 0.03])
#: Directions in which spam lies, as weights of FEATURES: lists of keywords or tags without sentences, stuffed sentences,
#: lists of links, hash tags, disguised words.
DIRECTIONS = {
    "list": (1, 1, 0, 0, 0, 0, 0),
    "stuffed": (0, 0, 1, 0.7, 0, 0, 0),
    "links": (1, 1, 0, 0, 1, 0, 0),
    "tags": (1, 0.5, 0, 0, 0, 1, 0),
    "disguised": (0, 0, 0, 0, 0, 0, 1),
}
#: Most labelled pages that the cut is fitted on, the cuts tried, and the cut where labels say nothing.
MOST_LABELS, CUTS, DEFAULT_CUT = 20_000, np.arange(4.0, 6.01, 0.25), 4.5
#: Least cosine between a page's deviation and the spam direction, in the whitened space.
LEAST_COSINE = 0.4
ANY = "*"


def page_features(documents: DataFrame) -> DataFrame:
    """``doc_id, language, n_words`` and FEATURES of every document (whole text); no rows are moved."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            language, words, matrix = feature_array(pdf["text"])
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "language": language, "n_words": words})
            for i, name in enumerate(FEATURES):
                out[name] = matrix[:, i]
            yield out

    schema = "doc_id bigint, language string, n_words bigint, " + ", ".join(f"{f} double" for f in FEATURES)
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(measure, schema)


def _by_language(rows: DataFrame, aggs: list[Column]) -> dict[str, dict]:
    """Aggregates per language and, under ANY, of all pages; as many rows as there are languages reach the driver."""
    both = rows.withColumn("language", F.explode(F.array("language", F.lit(ANY))))
    return {r["language"]: r.asDict() for r in both.groupBy("language").agg(*aggs).collect()}


def normal_pages(features: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per language the robust centre, scale and inverse covariance of the features, over all pages with words.

    A minimum covariance determinant estimate with a ridge: from medians and median absolute deviations, CONCENTRATIONS steps
    each take centre and covariance of the pages within the distance INSIDE of the step before. Centre and scale of a language
    lean towards those of all pages as if PRIOR_PAGES pages of all languages were among its own. Every step is one aggregation; a row
    per language reaches the driver.
    """
    k = len(FEATURES)
    judged = features.where(F.col("n_words") > 0)
    medians = lambda columns: [F.percentile_approx(c, 0.5, 10_000).alias(f) for c, f in zip(columns, FEATURES)]
    middle = _by_language(judged, [F.count(F.lit(1)).alias("pages"), *medians(FEATURES)])
    if not middle:
        return {}
    centres = {x: np.array([v[f] for f in FEATURES]) for x, v in middle.items()}

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[list(FEATURES)].to_numpy(float)
            centre = np.stack([centres[v] for v in pdf["language"]]) if len(pdf) else np.zeros((0, k))
            yield pd.DataFrame(np.abs(x - centre), columns=list(FEATURES)).assign(language=pdf["language"].to_numpy())

    both = judged.withColumn("language", F.explode(F.array("language", F.lit(ANY)))).select("language", *FEATURES)
    away = both.mapInPandas(apart, ", ".join(f"{f} double" for f in FEATURES) + ", language string")
    spread = {r["language"]: r for r in away.groupBy("language").agg(*medians(FEATURES)).collect()}
    scales = {x: np.maximum(1.4826 * np.array([r[f] for f in FEATURES]), LEAST_SCALE) for x, r in spread.items()}
    for x, v in middle.items():
        own = 1.0 if x == ANY else v["pages"] / (v["pages"] + PRIOR_PAGES)
        centres[x] = own * centres[x] + (1 - own) * centres[ANY]
        scales[x] = own * scales[x] + (1 - own) * scales[ANY]
    inner = {x: (np.zeros(k), np.eye(k)) for x in middle}
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    columns = ["pages", *(f"s_{i}" for i in range(k)), *(f"p_{i}_{j}" for i, j in pairs)]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for language, of in pdf.groupby("language"):
                z = (of[list(FEATURES)].to_numpy(float) - centres[language]) / scales[language]
                mean, inverse = inner[language]
                z = z[np.einsum("ij,jk,ik->i", z - mean, inverse, z - mean) < INSIDE]
                cross = z.T @ z
                rows.append((language, float(len(z)), *z.sum(axis=0), *(cross[i, j] for i, j in pairs)))
            yield pd.DataFrame(rows, columns=["language", *columns])

    for _ in range(CONCENTRATIONS):
        partial = both.mapInPandas(moments, "language string, " + ", ".join(f"{c} double" for c in columns))
        for r in partial.groupBy("language").agg(*(F.sum(c).alias(c) for c in columns)).collect():
            if r["pages"] < 2:
                continue
            mean, cov = np.array([r[f"s_{i}"] for i in range(k)]) / r["pages"], np.zeros((k, k))
            for i, j in pairs:
                cov[i, j] = cov[j, i] = r[f"p_{i}_{j}"] / r["pages"] - mean[i] * mean[j]
            inner[r["language"]] = (mean, np.linalg.inv(cov + RIDGE * np.eye(k)))
    return {x: (centres[x] + inner[x][0] * scales[x], scales[x], inner[x][1]) for x in middle}


def spam_scores(features: DataFrame, normal: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """``distance`` (robust Mahalanobis), ``score`` (its largest part along a spam direction) and that ``direction``."""
    names, ways = list(DIRECTIONS), np.array(list(DIRECTIONS.values()), dtype=float)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[list(FEATURES)].to_numpy(float)
            distance, score, way = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x), dtype=int)
            for language in pdf["language"].unique():
                at = (pdf["language"] == language).to_numpy()
                found = normal.get(language if language != "none" else ANY, normal.get(ANY))
                if found is None:
                    continue
                centre, scale, inverse = found
                z = (x[at] - centre) / scale
                distance[at] = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", z, inverse, z), 0))
                along = z @ inverse @ ways.T / np.sqrt(np.einsum("ij,jk,ik->i", ways, inverse, ways))
                score[at], way[at] = along.max(axis=1), along.argmax(axis=1)
            words = pdf["n_words"].to_numpy()
            trust = np.minimum(1.0, words / FULL_WORDS)
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "language": pdf["language"],
                    "n_words": words,
                    "distance": distance * trust,
                    "score": score * trust,
                    "direction": np.array(names)[way],
                }
            )

    return features.mapInPandas(judge, "doc_id bigint, language string, n_words bigint, distance double, score double, direction string")


def fitted_cut(scores: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> float:
    """The cut in CUTS that agrees best with the raters, the middle one of equally good ones.

    At most ``most`` labelled pages are used, those with the smallest hash; a page counts for the label most of its raters
    gave, ties and ``unsure`` count for none. Without labels of both kinds the cut is DEFAULT_CUT.
    """
    votes = labels.groupBy("doc_id").agg((F.count_if(F.col("label") == "spam") - F.count_if(F.col("label") == "ok")).alias("votes"))
    picked = votes.where("votes != 0 and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = scores.join(F.broadcast(picked), "doc_id").select("score", (F.col("votes") > 0).alias("spam")).collect()
    score, spam = np.array([r["score"] for r in rows]), np.array([r["spam"] for r in rows], dtype=bool)
    if not spam.any() or spam.all():
        return DEFAULT_CUT
    agree = np.array([((score > c) == spam).sum() for c in CUTS])
    best = np.flatnonzero(agree == agree.max())
    return float(CUTS[best[len(best) // 2]])


def spam_pages(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Every document with its verdict: ``doc_id, language, n_words, distance, score, direction, is_spam``.

    A page is spam if it is an outlier among the pages of its language (robust Mahalanobis distance over density,
    entropy, repetition and function-word features of its own content) and its deviation points in a spam direction.
    Menus, notices and footers are left aside; text read under a wrong charset is mended first; the language is taken
    from script and function words, as declared ones may be wrong. Statistics cover all documents; only a row per
    language and a bounded sample of labels reach the driver. Null and empty texts are no spam; the figures of a page of fewer than FULL_WORDS
    words count in proportion, so that a few words alone seldom are. Null labels
    or unknown ids in ``labels`` are ignored; without labels the default cut holds. An empty table gives no rows.
    """
    features = cut_lineage(page_features(documents))
    scores = spam_scores(features, normal_pages(features))
    cut = DEFAULT_CUT if labels is None else fitted_cut(scores, labels)
    return scores.withColumn(
        "is_spam", (F.col("score") > cut) & (F.col("score") >= LEAST_COSINE * F.col("distance"))
    )
