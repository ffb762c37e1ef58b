"""Mixing to target weights by iterative proportional fitting; DataFrame functions only.

Token counts are summed by source, language and topic (cells).  Raking scales the cells to each of the three
target marginals in turn until no marginal is off by more than ``tolerance`` of all tokens.  A cell's
weight over its tokens, times one scale, is the probability with which each of its documents is kept; the
draw is a hash of doc_id, so it can be repeated and joined by any task.

The scale meets a token budget, stated as such or as a ``rate`` of the input's tokens: cells that cannot
supply their part are kept whole, and the others share what is missing by weight.  So rare cells do not
set the size of the sample.  With neither, the scale is the largest that keeps no cell whole beyond its
weight (the targets are met exactly, however small the sample).

Defined results: null source, language or topic is a category of its own, written as a null; a null text has no tokens
and gets its cell's probability; cells without tokens get probability 1; documents repeated with one doc_id
share their draw, those without one draw by a hash of their text; a target absent from a given table is 0, its documents are left out; an empty
table gives no rows.  Other columns are kept; those named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import storage

DIMENSIONS = ("source", "lang", "topic")
#: The probabilities of up to so many cells (not documents) are broadcast; beyond that a shuffle join.
SMALL_CELLS = 200_000
#: The share of the input's tokens that the query and the pipeline keep.
PRODUCTION_RATE = 0.25


def topic_of(text: Column) -> Column:
    """A coarse genre of the whole text, by what it contains."""
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("icense")) | F.contains(text, F.lit("opyright")), "licence")
        .when(F.contains(text, F.lit("@")), "contact")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """Blank-separated words of the whole text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(dim, share) proportional to the tokens' share to a power: 1 keeps it, 0 makes all equal."""
    sums = cells.groupBy(dim).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("p")).where("p > 0")
    total = sums.agg(F.sum("p").alias("all"))
    return sums.join(F.broadcast(total), F.lit(True)).select(dim, (F.col("p") / F.col("all")).alias("share"))  # total is one row


def rake(cells: DataFrame, targets: dict[str, DataFrame], *, rounds: int = 30, tolerance: float = 1e-4) -> DataFrame:
    """cells (dimensions, tokens) with weight: shares that meet the targets as far as the cells allow; and ``residual``:
    by how much the last round still scaled the cell (0 when the targets are met; more where cells that do not
    exist keep ``rounds`` rounds from meeting them all)."""
    dims = list(targets)
    now = cells.withColumn("weight", F.col("tokens").cast("double")).withColumn("residual", F.lit(0.0))
    for turn in range(rounds):
        off = []
        for d in dims:
            t = targets[d].select(F.col(d).alias("__d"), F.col("share").alias("__share"))
            sums = now.groupBy(F.col(d).alias("__k")).agg(F.sum("weight").alias("__sum"))
            factor = sums.join(t.hint("merge"), F.col("__k").eqNullSafe(F.col("__d")), "left").select("__k", F.coalesce(F.try_divide("__share", "__sum"), F.lit(0.0)).alias("__f"))
            scaled = now.join(factor.hint("merge"), F.col(d).eqNullSafe(F.col("__k"))).withColumns({"weight": F.col("weight") * F.col("__f"), f"__off_{d}": F.abs(F.col("__f") - 1)}).drop("__k", "__f")
            now = scaled.checkpoint()  # else the next dimension's sums would compute this one again
            off.append(f"__off_{d}")
        worst = now.agg(F.max(F.when(F.col("weight") > 0, F.greatest(*off))).alias("w")).first()["w"]
        now = now.drop("residual").withColumn("residual", F.greatest(*off)).drop(*off)
        if turn and (worst is None or worst < tolerance):
            break
    return now


def scale_to(ratio: DataFrame, budget: float) -> float:
    """The scale at which cells (tokens, weight, ratio), none beyond its tokens, hold ``budget`` tokens together.

    Each turn finds the cells that cannot supply their part and deals the rest of the budget among the others.
    The scale only rises and the cells kept whole only grow in number, so this ends."""
    scale, before = 0.0, -1
    while True:
        whole = F.col("ratio") * scale >= 1
        row = ratio.where("weight > 0").agg(
            F.count_if(whole).alias("n"), F.sum(F.when(whole, F.col("tokens"))).alias("kept"), F.sum(F.when(~whole, F.col("weight"))).alias("open")
        ).first()
        if row["n"] == before:
            return scale
        if not row["open"]:  # even all that there is does not exceed the budget
            return float("inf") if row["n"] else 0.0
        scale, before = max(scale, (budget - (row["kept"] or 0)) / row["open"]), row["n"]


def mix(docs: DataFrame, *, targets: dict[str, DataFrame] | None = None, power: float = 0.7, budget_tokens: float | None = None, rate: float | None = None, topic: Column | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 1e-4) -> DataFrame:
    """``docs`` with topic, tokens, probability and sampled; at most one of ``budget_tokens`` and ``rate``."""
    if budget_tokens is not None and rate is not None:
        raise ValueError("state a budget or a rate, not both")
    storage.shared_dir(docs.sparkSession)
    new = {"topic", "tokens", "probability", "sampled"}
    text = F.col(text_col)
    topic = topic if topic is not None else topic_of(text)
    docs = docs.select(*[c for c in docs.columns if c not in new], topic.alias("topic"), tokens_of(text).alias("tokens"))
    cells = docs.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")).checkpoint()
    few = cells.count() <= SMALL_CELLS
    some = cells.where("tokens > 0")
    found = {d: (targets or {}).get(d) or tempered(some, d, power).checkpoint() for d in DIMENSIONS}
    raked = rake(some, found, tolerance=tolerance)
    ratio = raked.withColumn("ratio", F.col("weight") / F.col("tokens"))
    if rate is not None:
        budget_tokens = rate * (some.agg(F.sum("tokens")).first()[0] or 0)
    if budget_tokens is None:
        scale = ratio.agg((1 / F.max("ratio")).alias("scale"))
    else:
        scale = docs.sparkSession.range(1).select(F.lit(scale_to(ratio, float(budget_tokens))).alias("scale"))
    per_cell = ratio.join(F.broadcast(scale), F.lit(True)).select(  # scale is one row
        *[F.col(d).alias(f"__{d}") for d in DIMENSIONS], F.when(F.col("ratio") > 0, F.least(F.lit(1.0), F.col("ratio") * F.col("scale"))).otherwise(0.0).alias("__p")
    ).checkpoint()
    on = [F.col(d).eqNullSafe(F.col(f"__{d}")) for d in DIMENSIONS]
    out = docs.join(F.broadcast(per_cell) if few else per_cell, on, "left").drop(*[f"__{d}" for d in DIMENSIONS])
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.xxhash64(text_col).cast("string"))), F.lit(str(seed)))), 1, 13), 16, 10).cast("double") / float(16**13)
    return out.withColumn("probability", F.coalesce("__p", F.lit(1.0))).withColumn("sampled", draw < F.col("probability")).drop("__p")
