"""Reading level of each document.

``fit_levels`` learns from pages graded by human raters; ``predict_levels``
gives every page its band.

Method: each word's acquisition grade is estimated from graded text: the share
of each grade in the word's occurrences, every grade weighing the same, gives
the grade at which half of its use is reached (interpolated). A page is
described by quantiles of the grades of its known words. Calibration on the
graded pages gives each band the median of these quantiles as its centre, and a
page gets the band of the nearest centre (differences weighed by the spread
within bands). Words need ``min_pages`` graded pages to be known.
Broken line ends are joined; words the model doesn't know, among them most
misread ones, don't count.

Bounds: the model is fitted on at most ``max_pages`` graded pages (chosen by
hash of the id), counted on the workers; its vocabulary is bounded by their
text and by ``min_pages``. The graded ids alone, no more than ``max_pages``, are
broadcast. The corpus is read twice: to pick the graded pages, and to give every
page its band, whole texts in Python workers.

Defined results: raters' grades are combined by the mean of non-null grades,
repeated labels count once; pages graded by nobody aren't used for fitting, and
of several texts with one graded id the greatest is.
A page without known words, a null text among them, gets the band at the middle
of the calibration, and ``known_words`` 0 marks it. Without any graded page every band is
null. Extra columns and repeated pages are kept apart by row.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import spread, written

WORD = re.compile(r"[a-z]+(?:'[a-z]+)?")
BREAK = re.compile(r"[-=¬­] ?\r?\n")
QUANTILES = (0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9)


@dataclass(frozen=True)
class ReadingParams:
    max_pages: int = 20_000
    min_pages: int = 4
    bands: tuple[int, ...] = (1, 2, 3, 4)


@dataclass
class LevelModel:
    grade: dict[str, float] = field(default_factory=dict)
    centres: list[list[float]] = field(default_factory=list)  # of the quantiles, by band
    bands: list[int] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)
    fallback: int | None = None


def words_of(text: str) -> list[str]:
    return WORD.findall(BREAK.sub("", text.lower()))


def _features(words: list[str], grade: dict[str, float]) -> np.ndarray | None:
    known = [g for g in map(grade.get, words) if g is not None]
    return np.quantile(np.array(known), QUANTILES) if known else None


def _band_index(grade: float, params: ReadingParams) -> int:
    return int(np.argmin([abs(grade - b) for b in params.bands]))


def _grades(counts: dict[str, np.ndarray], total: np.ndarray, params: ReadingParams) -> dict[str, float]:
    """Acquisition grade of each word: where half of its use is reached, all bands weighing the same."""
    grade = {}
    for w, c in counts.items():
        r = c / np.maximum(total, 1)
        share = np.cumsum(r / r.sum())
        k = int(np.searchsorted(share, 0.5))
        below = share[k - 1] if k else 0.0
        grade[w] = params.bands[k] - 0.5 + float((0.5 - below) / max(share[k] - below, 1e-12))
    return grade


def _calibrated(grade: dict[str, float], x: np.ndarray, y: np.ndarray, params: ReadingParams) -> LevelModel:
    """Centres of the quantiles by band, and their spread."""
    model = LevelModel(grade=grade)
    if not len(x):
        return model
    spread = np.zeros(x.shape[1])
    for b in np.unique(y):
        centre = np.median(x[y == b], axis=0)
        model.centres.append(centre.tolist())
        model.bands.append(params.bands[int(b)])
        spread = spread + np.abs(x[y == b] - centre).sum(axis=0)
    model.spread = np.maximum(spread / len(y), 0.02).tolist()
    model.fallback = model.bands[len(model.bands) // 2]
    return model


def _counted(pages: list[tuple[str, int]], n_bands: int) -> pd.DataFrame:
    """Of some pages (text, band): word, pages it stands on, uses by band."""
    uses: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n_bands + 1, np.int64))
    for text, band in pages:
        for w, n in Counter(words_of(text)).items():
            uses[w][band] += n
            uses[w][n_bands] += 1
    if not uses:
        return pd.DataFrame({"word": [], "pages": [], **{f"c{b}": [] for b in range(n_bands)}}).astype({"word": "object", "pages": "int64", **{f"c{b}": "int64" for b in range(n_bands)}})
    table = np.stack(list(uses.values()))
    return pd.DataFrame({"word": list(uses), "pages": table[:, n_bands], **{f"c{b}": table[:, b] for b in range(n_bands)}})


def fit_on(pages: list[tuple[str, float]], params: ReadingParams = ReadingParams()) -> LevelModel:
    """``pages``: texts with their mean grade, in this process."""
    n = len(params.bands)
    banded = [(t, _band_index(g, params)) for t, g in pages]
    table = _counted(banded, n)
    bands = [f"c{b}" for b in range(n)]
    known = table[table["pages"] >= params.min_pages]
    grade = _grades(dict(zip(known["word"], known[bands].to_numpy(float))), table[bands].sum().to_numpy(float), params)
    rows = [(f, b) for t, b in banded if (f := _features(words_of(t), grade)) is not None]
    return _calibrated(grade, np.array([f for f, _ in rows]), np.array([b for _, b in rows]), params)


def fit_levels(documents: DataFrame, labels: DataFrame, params: ReadingParams = ReadingParams()) -> LevelModel:
    """Fits on at most ``params.max_pages`` graded pages, whose texts stay on the workers: the driver gets words and quantiles."""
    n = len(params.bands)
    distance = [F.struct(F.abs(F.avg("grade") - b).alias("d"), F.lit(k).alias("k")) for k, b in enumerate(params.bands)]
    graded = (
        labels.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull())
        .select("label_id", "doc_id", "rater", "grade").distinct()
        .groupBy("doc_id").agg(F.least(*distance)["k"].alias("_band"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_pages)
    )
    # Bounded by max_pages rows, so it may go to all workers; the pages aren't shuffled.
    pages = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(graded), "doc_id")
    pages = written(pages.groupBy("doc_id", "_band").agg(F.max("text").alias("text")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _counted(list(zip(pdf["text"], pdf["_band"])), n)

    bands = [f"c{b}" for b in range(n)]
    words = pages.select("text", "_band").mapInPandas(count, ", ".join(["word string", "pages bigint", *(f"{b} bigint" for b in bands)]))
    table = written(words.groupBy("word").agg(F.sum("pages").alias("pages"), *[F.sum(b).alias(b) for b in bands]))
    rows = table.where(F.col("pages") >= params.min_pages).toPandas()
    total = np.array([x or 0 for x in table.agg(*[F.sum(b) for b in bands]).first()], float)
    grade = _grades(dict(zip(rows["word"], rows[bands].to_numpy(float))), total, params)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(_features(words_of(t), grade), b) for t, b in zip(pdf["text"], pdf["_band"])]
            yield pd.DataFrame([(f.tolist(), b) for f, b in found if f is not None], columns=["f", "b"])

    described = pages.select("text", "_band").mapInPandas(describe, "f array<double>, b int").collect()
    return _calibrated(grade, np.array([r["f"] for r in described]), np.array([r["b"] for r in described]), params)


def band_of(text: str | None, model: LevelModel) -> tuple[int | None, int]:
    """Band and number of known words."""
    known = [g for g in map(model.grade.get, words_of(text)) if g is not None] if text else []
    if not known or not model.bands:
        return (model.fallback if model.bands else None), len(known)
    distance = (np.abs(np.array(model.centres) - np.quantile(np.array(known), QUANTILES)) / np.array(model.spread)).sum(axis=1)
    return model.bands[int(distance.argmin())], len(known)


def predict_levels(documents: DataFrame, model: LevelModel) -> DataFrame:
    """Columns ``doc_id``, ``band`` and ``known_words``, one row a page."""

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [band_of(t, model) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "band": pd.array([b for b, _ in found], dtype="Int32"), "known_words": [n for _, n in found]})

    return spread(documents.select("doc_id", "text")).mapInPandas(predict, "doc_id bigint, band int, known_words bigint")
