"""Mixing sources to target weights.

``mix_sources`` combines pages of several sources so that each supplies its
target share of all tokens, none used more often than its source allows.

Method: Efraimidis-Spirakis weighted sampling. A page's key is an exponential
draw divided by its quality weight; pages of a source in key order are a
weighted sample without replacement, and the prefix sum of their tokens is cut
at the source's budget. Whole epochs come first: a source whose budget is 2.4
times its size gives every page twice and a sample of 0.4 of its tokens once
more. Draws are hashes of the page and a seed, so reruns and lost executors
give the same set.

Scale: no source is sorted as a whole. Keys are binned by their logarithm: an
exponential draw's logarithm has one shape whatever the weight, which only moves
it, so a bin holds at most ``1 / (e * bins)`` of a source however its weights
are mixed. Token sums per source and bin (partial aggregation) give each bin's
offset, all bins below the budget are taken whole, and only the one bin per
source that holds the cut is sorted. Tokens are counted once a page, in Python workers,
over whole texts of targeted sources only.

The total: ``total_tokens``, or else the most at which every source that has
pages can meet its share within its repeats. Shares of sources without any
page can't be met; the reached shares are reported beside the targets.

Defined results: pages of null or untargeted sources are left out; null and
empty texts have no tokens and are never chosen; repeated rows are pages of
their own; null or non-positive weights count as ``least_weight``. Negative or
null targets count as 0, null repeats as 1. Several rows for one source act by
the sum of shares and the least repeats. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import written


@dataclass(frozen=True)
class MixParams:
    vocabulary: str | None = None  # ranks of a public tokenizer, on every worker; None: the session's ``spark.barloom.vocabulary``, else ``VOCABULARY``
    pattern: str | None = None  # its splitting pattern; None: the one published beside the file
    total_tokens: int | None = None
    seed: int = 20_24
    bins: int = 1_024  # to the factor e in the keys
    least_weight: float = 0.05


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_encoders: dict[tuple, object] = {}
#: Fixed value: splitting pattern published with the byte-level vocabulary.
BYTE_BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoder(path: str, pattern: str | None):
    if (path, pattern) not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        _encoders[path, pattern] = tiktoken.Encoding(os.path.basename(path), pat_str=pattern or BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def count_tokens(documents: DataFrame, params: MixParams = MixParams(), text: str = "text") -> DataFrame:
    """``documents`` without the text, with ``n_tokens`` of it."""
    kept = [c for c in documents.columns if c != text]
    schema = documents.select(*kept).schema.add("n_tokens", "long")
    path = params.vocabulary or documents.sparkSession.conf.get("spark.barloom.vocabulary", VOCABULARY)
    pattern = params.pattern

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(path, pattern).encode_ordinary
        for pdf in batches:
            out = pdf.drop(columns=text)
            # Paragraph-sized pieces: the splitter never joins across a line end followed by a non-blank.
            out["n_tokens"] = [sum(len(encode(x)) for x in _pieces(t)) if isinstance(t, str) else 0 for t in pdf[text]]
            yield out

    return documents.select(*kept, text).mapInPandas(count, schema)


def _pieces(text: str, size: int = 200_000) -> Iterator[str]:
    """Very long texts in pieces cut before a line end, where the splitting pattern always has a boundary."""
    at = 0
    while len(text) - at > size:
        cut = text.find("\n", at + size)
        while cut > 0 and cut + 1 < len(text) and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find("\n", cut + 1)
        if cut <= 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def scan_quality(boxes: Column) -> Column:
    """Mean confidence of the scanned lines; null where there are none."""
    return F.aggregate(F.filter(boxes, lambda b: b["conf"].isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
                       lambda a, b: F.struct((a["s"] + b["conf"]).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))


def _plan(sizes: DataFrame, params: MixParams) -> DataFrame:
    """Budget, whole epochs and fractional tokens of each source; one row a source."""
    supply = F.col("max_repeats") * F.col("available") / F.col("target_share")
    most = F.min(F.when((F.col("available") > 0) & (F.col("target_share") > 0), supply)).over(Window.partitionBy())
    total = F.lit(params.total_tokens).cast("double") if params.total_tokens is not None else most
    wanted = F.floor(F.coalesce(total, F.lit(0.0)) * F.col("target_share") + 1e-6)
    budget = F.least(wanted, F.col("max_repeats") * F.col("available")).cast("bigint")
    epochs = F.when(F.col("available") > 0, F.floor(F.col("_budget") / F.col("available"))).otherwise(0).cast("int")
    return sizes.withColumn("_budget", budget).withColumn("_epochs", epochs).withColumn("_rest", F.col("_budget") - F.col("_epochs") * F.col("available"))


def mix_sources(documents: DataFrame, targets: DataFrame, *, weight: Column | None = None, params: MixParams = MixParams()) -> tuple[DataFrame, DataFrame]:
    """(mix, shares). Mix: ``doc_id``, ``source``, ``n_tokens``, ``copies``. Shares: ``source``, ``target_share``, ``max_repeats``, ``docs``, ``available``, ``used``, ``actual_share``."""
    goals = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.sum(F.greatest(F.coalesce(F.nanvl(F.col("target_share"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))).alias("target_share"),
        F.greatest(F.min(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).cast("int").alias("max_repeats"),
    )
    w = weight if weight is not None else F.lit(1.0)
    draw = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("source"), F.lit(params.seed)), 11).cast("double") + 0.5) / float(1 << 53)
    pages = documents.select("doc_id", "source", "text", F.greatest(F.coalesce(F.nanvl(w.cast("double"), F.lit(None).cast("double")), F.lit(params.least_weight)), F.lit(params.least_weight)).alias("_w"))
    pages = pages.join(goals.select("source"), "source", "left_semi").where(F.length("text") > 0)
    sized = count_tokens(pages, params).where(F.col("n_tokens") > 0)
    # Smallest key first.
    sized = written(sized.withColumn("_key", -F.log(draw) / F.col("_w")).withColumn("_bin", F.floor(F.log("_key") * params.bins).cast("int")).drop("_w"))
    bins = sized.groupBy("source", "_bin").agg(F.sum("n_tokens").alias("_t"), F.count("*").alias("_n"))
    sizes = goals.join(bins.groupBy("source").agg(F.sum("_t").alias("available"), F.sum("_n").alias("docs")), "source", "left").fillna(0, ["available", "docs"])
    plan = written(_plan(sizes, params))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    state = bins.withColumn("_before", before).join(plan.select("source", "_epochs", "_rest"), "source")
    state = state.select("source", "_bin", "_before", "_epochs", "_rest", (F.col("_before") + F.col("_t") <= F.col("_rest")).alias("_whole"), ((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_t") > F.col("_rest"))).alias("_cut"))
    rows = sized.join(state, ["source", "_bin"])
    clear = rows.where(~F.col("_cut")).select("doc_id", "source", "n_tokens", (F.col("_epochs") + F.col("_whole").cast("int")).alias("copies"))
    order = Window.partitionBy("source").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where("_cut").withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(order))
    edge = edge.select("doc_id", "source", "n_tokens", (F.col("_epochs") + (F.col("_upto") <= F.col("_rest")).cast("int")).alias("copies"))
    mix = clear.unionByName(edge).where(F.col("copies") > 0)
    used = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used"))
    reached = plan.join(used, "source", "left").fillna(0, ["used"])
    whole = F.sum("used").over(Window.partitionBy())
    shares = reached.select("source", "target_share", "max_repeats", "docs", "available", "used", F.when(whole > 0, F.col("used") / whole).otherwise(F.lit(0.0)).alias("actual_share"))
    return mix, shares
