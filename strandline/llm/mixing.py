"""Mixing sources to target weights along a curriculum (problem 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.keys import key_form
from strandline.operators.ordering import running_total


def _decimal(c: str) -> Column:
    return F.col(c).cast("decimal(12,6)")


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source in key form and tokens (bytes of the UTF-8 text; null texts have none)."""
    return docs.select("doc_id", key_form("source").alias("source"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("tokens"))


def mix_plan(sized: DataFrame, targets: DataFrame, tilts: dict[str, float] | None = None) -> DataFrame:
    """Per target source: tokens it has, tokens it should give (demand), tokens it may give (cap) and will give (budget), and its tilt.

    The total is that of all documents whose source is among the targets; repeated rows count each time. A source
    gives at most max_repeats times its tokens. Spellings of one source in the targets are added up; blank target
    sources, null shares and null or negative repeat counts give nothing.
    A source's weight runs linearly from budget x (1 - tilt) at the start to budget x (1 + tilt) at the end of training;
    tilts go from -1 to 1, by source in key form, 0 where none is given. The weights of all sources have to add up to
    the same at every point, so rising and falling tilts must balance: the heavier side is scaled down until they do.
    A source without a tilt stays constant, and every source gives its budget over the whole of training.
    """
    want = (
        targets.select(key_form("source").alias("source"), _decimal("target_share").alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("long").alias("max_repeats"))
        .dropna(subset=["source"])
        .groupBy("source")
        .agg(F.sum(F.coalesce("target_share", F.lit(0))).cast("decimal(12,6)").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    have = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs"))
    plan = want.join(have, "source", "left").fillna(0, ["tokens", "n_docs"])
    total = plan.agg(F.sum("tokens")).scalar()
    demand = (F.col("target_share") * total).cast("decimal(38,6)")
    plan = plan.withColumn("demand", F.coalesce(demand, F.lit(0))).withColumn("cap", F.col("max_repeats") * F.col("tokens"))
    plan = plan.withColumn("budget", F.least(F.ceil("demand").cast("long"), F.col("cap")))
    pairs = [F.lit(x) for kv in (tilts or {}).items() for x in (kv[0], float(kv[1]))]
    asked = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
    every = Window.partitionBy()  # a row for each target source
    plan = plan.withColumn("_asked", asked).withColumn("_rise", F.sum(F.col("budget") * F.greatest("_asked", F.lit(0.0))).over(every)).withColumn("_fall", F.sum(F.col("budget") * F.greatest(-F.col("_asked"), F.lit(0.0))).over(every))
    own = F.when(F.col("_asked") > 0, F.col("_rise")).otherwise(F.col("_fall"))
    return plan.withColumn("tilt", F.when(F.col("_asked") == 0, 0.0).otherwise(F.coalesce(F.col("_asked") * F.try_divide(F.least("_rise", "_fall"), own), F.lit(0.0)))).drop("_asked", "_rise", "_fall")


def placed(sized: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """Every use of a document: (doc_id, source, tokens, use, reached, position).

    A source's documents stand in a permuted order, one pass after the other, and demand is met from them in turn.
    `reached` is the source's cumulative tokens with this use. Cumulative demand of a source up to t is
    budget x ((1 - tilt) t + tilt t^2); the position of a use is the t at which that is the tokens before its middle.
    As the weights of all sources add up to a constant, t is also the share of the whole mix's tokens that come before.
    A use is kept while the tokens before it are below the budget, so a source exceeds its budget by less than a text.
    """
    rows = running_total(sized.where("source is not null and tokens > 0"), ["source"], ["doc_id"], "tokens", seed, "_before")
    # a plan has one row for each target source
    uses = rows.join(plan.select("source", "budget", "tilt", F.col("tokens").alias("_all")), "source").where("budget > _before")
    uses = uses.withColumn("use", F.explode(F.expr("sequence(0L, (budget - _before - 1) div _all)"))).withColumn("_start", F.col("use") * F.col("_all") + F.col("_before"))
    k = F.col("tilt")
    u = F.least((F.col("_start") + F.col("tokens") / 2) / F.col("budget"), F.lit(1.0)).cast("double")
    root = F.sqrt((1 - k) * (1 - k) + 4 * k * F.col("_u"))
    solved = 2 * F.col("_u") / ((1 - k) + root)  # the form of the root that holds for a tilt of 0 as well
    located = uses.withColumn("_u", u).withColumn("position", solved).withColumn("reached", F.col("_start") + F.col("tokens"))
    return located.select("doc_id", "source", "tokens", "use", "reached", "position")


def mix(sized: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """Every use of a document with its position in training, range-sorted by it."""
    uses = placed(sized, plan, seed).drop("reached")
    return uses.repartitionByRange("position", "source", "doc_id", "use").sortWithinPartitions("position", "source", "doc_id", "use")


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and actual share of every source, from the uses placed in training.

    `ran_out`: all permitted repeats were placed and the demand was not reached. `last_met` is the point of training (0 to 1) up
    to which the demand of the target share would have been met from these; 1 where it was met throughout.
    """
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.max(F.col("use") + 1).alias("most_uses"), F.max("reached").alias("reached"))
    both = plan.join(got, "source", "left").fillna(0, ["mixed_tokens", "most_uses", "reached"])
    total = F.sum("mixed_tokens").over(Window.partitionBy())  # a row for each target source
    u, k = F.least(F.coalesce(F.try_divide(F.col("reached").cast("double"), F.col("demand").cast("double")), F.lit(1.0)), F.lit(1.0)), F.col("tilt")
    return both.select(
        "source", F.col("target_share").cast("double").alias("target_share"), "tokens", "mixed_tokens", "most_uses",
        F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), total), F.lit(0.0)).alias("actual_share"), (F.col("reached") < F.col("demand")).alias("ran_out"),
        F.when(u == 0, 0.0).otherwise(2 * u / ((1 - k) + F.sqrt((1 - k) * (1 - k) + 4 * k * u))).alias("last_met"),
    )
