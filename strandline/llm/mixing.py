"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell (one value of each dimension).  Each sweep scales
the cells' weights to one dimension's target shares after the other.  A
document is then drawn with the probability of its cell: fitted weight over
tokens, scaled so that the largest probability is 1, which is the largest
sample that meets the targets without repeating a document.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import WORD, cut, utf8, whole_row

#: Sweeps of one job; how near they came is looked at after each.
SWEEPS_A_JOB = 2

#: Cells up to which their table is sent to all executors; beyond it is joined by exchange.
BROADCAST_CELLS = 50_000

#: What a target leaves of 1 counts as nothing up to here (sums of decimal shares are not exact).
NOTHING_LEFT = 1e-9

#: A target: shares by value, or an exponent that tempers the natural shares.
Target = Mapping[str, float] | float


def content_topic(text: Column) -> Column:
    """A coarse topic from the text's form: tabular, shouting, noisy or prose."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.contains(" | "), "tabular").when(text.contains("!!"), "shouting").when(text.rlike("[#$%&*]{3}"), "noisy").otherwise("prose")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _values(cells: DataFrame, dim: str, target: Target) -> DataFrame:
    """The values of ``dim`` among ``cells`` and their target shares, ``_t_<dim>``.

    Values that the target does not name share what it leaves of 1 in
    proportion to their tokens; where it leaves nothing, they keep their natural
    share and the named values divide the rest.  A value is left out by naming it
    with 0.  Shares of values that are absent go to the others.
    """
    values = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("_m"))
    if isinstance(target, Mapping):
        named = F.lit(None).cast("double")
        for value, share in target.items():
            named = F.when(F.col(dim) == F.lit(value), F.lit(float(share))).otherwise(named)
        left = max(0.0, 1.0 - sum(target.values()))
        values = values.withColumn("_s", named)
        is_unnamed = F.col("_s").isNull()
        sums = values.agg(F.sum(F.when(is_unnamed, F.col("_m"))).alias("_u"), F.sum(F.when(~is_unnamed, F.col("_m"))).alias("_k"), F.sum("_s").alias("_n"))
        if left > NOTHING_LEFT:
            rest = F.lit(left) * F.col("_m") / F.when(F.col("_u") > 0, F.col("_u"))
        else:
            rest = F.when((F.col("_k") > 0) & (F.col("_n") > 0), F.col("_n") * F.col("_m") / F.col("_k")).otherwise(F.col("_m"))
        values = values.crossJoin(F.broadcast(sums)).select(dim, F.coalesce("_s", rest).alias("_s"))
    else:
        values = values.select(dim, F.pow("_m", F.lit(float(target))).alias("_s"))
    total = values.agg(F.sum("_s").alias("_all"))
    # One row, of one number.
    return values.crossJoin(F.broadcast(total)).select(dim, F.when(F.col("_all") > 0, F.col("_s") / F.col("_all")).otherwise(0.0).alias(f"_t_{dim}"))


def _shares(cells: DataFrame, targets: Mapping[str, Target]) -> DataFrame:
    """``cells`` with the target share of each cell's value of each dimension.

    Every dimension's values come from ``cells`` itself and not from what the dimensions before it
    made, so that the plan grows with their number and not with its powers.
    """
    out = cells
    for dim, target in targets.items():
        out = out.join(_values(cells, dim, target), dim)
    return out


def _gaps(cells: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """dim, value, target, share and gap of each marginal of raked cells, in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("value"), F.col(f"_t_{d}").alias("target")) for d in dims))).alias("m")
    out = cells.select(each, "weight").groupBy("m.dim", "m.value").agg(F.max("m.target").alias("target"), F.sum("weight").alias("weight"))
    # The weights of each dimension add up to the same.
    out = out.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("dim")))
    return out.select("dim", "value", "target", "share", F.abs(F.col("share") - F.col("target")).alias("gap"))


def gaps(raked: DataFrame, targets: Mapping[str, Target]) -> DataFrame:
    """dim, value, target, share and gap of each marginal: how near the fit of ``rake`` came."""
    return _gaps(_shares(raked, targets), tuple(targets))


def rake(cells: DataFrame, targets: Mapping[str, Target], *, sweeps: int, tolerance: float = 1e-13) -> DataFrame:
    """``cells`` (the dimensions and ``tokens``) with ``weight``, whose marginals meet the targets.

    Sweeps end when no marginal is further from its target than ``tolerance``, or after
    ``sweeps``.  Targets that cannot be met together (a value of one dimension that stands in cells
    of one value of another only, say) never come that near: then the last dimension's are met, and
    ``gaps`` tells what is missing of the others.  Up to ``BROADCAST_CELLS`` cells are fitted in one
    task, without an exchange; more are fitted by exchanges.
    """
    few = cells.count() <= BROADCAST_CELLS
    with _interpreted(cells.sparkSession) if few else nullcontext():
        return _raked(cells, targets, sweeps, tolerance, few)


@contextmanager
def _interpreted(spark: SparkSession) -> Iterator[None]:
    """No code is generated meanwhile: for some cells it costs more time and memory of the driver than it saves."""
    own = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _raked(cells: DataFrame, targets: Mapping[str, Target], sweeps: int, tolerance: float, few: bool) -> DataFrame:
    together = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    out = cut(_shares(together(cells), targets).withColumn("weight", F.col("tokens").cast("double")), "cells")
    for sweep in range(sweeps):
        out = together(out)
        for dim in targets:
            mass = F.sum("weight").over(Window.partitionBy(dim))
            out = out.withColumn("weight", F.when(mass > 0, F.col("weight") * F.col(f"_t_{dim}") / mass).otherwise(0.0))
        if sweep % SWEEPS_A_JOB == SWEEPS_A_JOB - 1 or sweep == sweeps - 1:
            out = cut(out, "raked")
            if (_gaps(together(out), tuple(targets)).agg(F.max("gap")).first()[0] or 0.0) <= tolerance:
                break
    return out.drop(*(f"_t_{dim}" for dim in targets))


def mix(
    docs: DataFrame, dims: Mapping[str, Column], targets: Mapping[str, Target], *, sweeps: int = 10, seed: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the dimensions, ``n_tokens`` (words), ``prob`` and ``sampled``.

    A null value of a dimension is a value of its own, "(null)".  Documents
    without words weigh nothing and get the probability of their cell, or 0 in a
    cell without words.  Rows of one id share their draw.  An empty table gives
    no rows.  Input columns with a result's name are replaced.
    """
    if set(dims) != set(targets):
        raise ValueError("every dimension needs a target")
    named = {d: F.coalesce(c.cast("string"), F.lit("(null)")) for d, c in dims.items()}
    own = "_" * (1 + max(len(c) for c in docs.columns))  # no input column's name begins so
    rows = docs.withColumns({**{f"{own}{d}": c for d, c in named.items()}, "n_tokens": F.regexp_count(utf8(text_col), F.lit(WORD)).cast("long")})
    counted = rows.groupBy(*(F.col(f"{own}{d}").alias(d) for d in dims)).agg(F.sum("n_tokens").alias("tokens"))
    # Shares of each dimension come from the cells, so the texts are counted once.
    counted = cut(counted, "counted")
    cells = rake(counted, targets, sweeps=sweeps)
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    cells = cells.withColumn("_rate", rate)
    top = cells.agg(F.max("_rate").alias("_top"))
    cells = cells.crossJoin(F.broadcast(top)).select(*(F.col(d).alias(f"{own}{d}") for d in dims), F.when(F.col("_top") > 0, F.col("_rate") / F.col("_top")).otherwise(0.0).alias("prob"))
    cells = cut(cells, "probabilities")
    if cells.count() <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    out = rows.drop("prob").join(cells, [f"{own}{d}" for d in dims], "left")
    out = out.withColumns({d: F.col(f"{own}{d}") for d in dims}).drop(*(f"{own}{d}" for d in dims))
    return out.withColumn("sampled", uniform(F.col(id_col), seed) < F.col("prob"))


def sample(docs: DataFrame, dims: Mapping[str, Column], targets: Mapping[str, Target], **options) -> DataFrame:
    """The drawn rows with the columns of ``docs`` as they were."""
    id_col, text_col = options.pop("id_col", "doc_id"), options.pop("text_col", "text")
    rows = docs.select(whole_row(docs), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(c.cast("string").alias(d) for d, c in dims.items()))
    drawn = mix(rows, {d: F.col(d) for d in dims}, targets, **options)
    return drawn.where("sampled").select("row.*")
