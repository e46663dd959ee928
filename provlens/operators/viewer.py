"""Result viewer on Spark: choose drugs, rank providers, format, chart data.

The input is the wide profile (provider block, affiliation block, one column
per measure) plus its measure list; measure columns are found by the list,
never by splitting column names, so drug names with ``_`` or ``)`` and the
``OTHERS_GENERAL`` category are handled.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provlens.functions.normalise import sql_ident
from provlens.functions.text import format_postal
from provlens.operators.affiliations import affiliation_block
from provlens.operators.engagement import CLAIM_MEASURES, Measure, measures_frame, totals_by_measure
from provlens.operators.registry import provider_block
from provlens.plans.position import with_position

ALL = "All"


def chosen_measures(measures: Sequence[Measure], drugs: Iterable[str]) -> list[Measure]:
    drugs = list(drugs)
    if ALL in drugs:
        return list(measures)
    wanted = {d.upper() for d in drugs}
    return [m for m in measures if m.drug in wanted]


def _q(name: str):
    return F.col(sql_ident(name))


def view_filtered(profile: DataFrame, measures: Sequence[Measure], drugs: Iterable[str],
                  k: int = 4) -> DataFrame:
    """npi as text, provider and affiliation blocks, measures of chosen drugs."""
    desc = [c for c in provider_block(profile)[1:] + list(affiliation_block(k)) if c in profile.columns]
    chosen = chosen_measures(measures, drugs)
    return profile.select(F.col("npi").cast("string").alias("npi"), *desc,
                          *[_q(m.name) for m in chosen])


def row_total(names: Sequence[str]):
    """Sum of the named columns (nulls as 0) as an array fold: Catalyst does
    not expand it into constraints, unlike a long ``c1 + c2 + ...``."""
    if not names:
        return F.lit(0).cast("bigint")
    items = ", ".join(f"coalesce(CAST({sql_ident(n)} AS BIGINT), 0L)" for n in names)
    return F.expr(f"aggregate(array({items}), 0L, (acc, x) -> acc + x)")


def totalled(view: DataFrame, measures: Sequence[Measure], drugs: Iterable[str],
             only: Iterable[str] | None = None) -> DataFrame:
    """Rows with total > 0 over the chosen measures. The total adds dollars,
    patients and claims alike, as the reference does; ``only`` restricts it to
    the named measures (e.g. the payment categories, for dollars)."""
    wanted = None if only is None else set(only)
    chosen = [m.name for m in chosen_measures(measures, drugs)
              if m.name in view.columns and (wanted is None or m.measure in wanted)]
    return view.withColumn("total", row_total(chosen)).where(F.col("total") > 0)


def ranked_view(view: DataFrame, measures: Sequence[Measure], drugs: Iterable[str],
                only: Iterable[str] | None = None, top: int | None = None) -> DataFrame:
    """The rows of ``totalled`` by descending total (ties by npi): a range
    sort, or with ``top`` only the first rows (each task keeps that many)."""
    out = totalled(view, measures, drugs, only).orderBy(F.desc("total"), F.asc("npi"))
    return out if top is None else out.limit(top)


def ranked_positions(view: DataFrame, measures: Sequence[Measure], drugs: Iterable[str]) -> DataFrame:
    """npi, total and position in the ranked view, in order; only the keys are
    numbered."""
    keys = totalled(view, measures, drugs).select("npi", "total")
    return with_position(keys, [F.desc("total"), F.asc("npi")], "position")


def positioned_view(view: DataFrame, measures: Sequence[Measure], drugs: Iterable[str]) -> DataFrame:
    """The ranked view with its positions: the wide rows meet their numbered
    keys and are sorted by position."""
    rows = totalled(view, measures, drugs)
    keys = ranked_positions(view, measures, drugs).select(F.col("npi").alias("_npi"), "position")
    return rows.join(keys, rows["npi"] == keys["_npi"]).drop("_npi").orderBy("position")


def view_display(ranked: DataFrame, k: int = 4) -> DataFrame:
    """Display form: postal code formatted; empty descriptive cells as ''."""
    blanks = [c for c in provider_block(ranked)[1:] + list(affiliation_block(k)) if c in ranked.columns]
    out = []
    for c in ranked.columns:
        if c == "postal_code":
            out.append(F.coalesce(format_postal(c), F.lit("")).alias(c))
        elif c in blanks:
            out.append(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c))
        else:
            out.append(_q(c))
    return ranked.select(*out)


def measure_totals(facts: DataFrame, measures: Sequence[Measure], spark: SparkSession) -> DataFrame:
    """Sums per (drug, measure) for the listed measures, 0 where there is no
    fact; from facts of the viewed providers, without a pivot."""
    if not measures:
        return spark.createDataFrame([], "drug string, measure string, amount bigint")
    listed = F.broadcast(measures_frame(spark, measures).select("drug", "measure"))  # bounded by the pivot limit
    return (listed.join(totals_by_measure(facts), ["drug", "measure"], "left")
            .select("drug", "measure", F.coalesce("amount", F.lit(0).cast("bigint")).alias("amount")))


def drug_category_totals(facts: DataFrame, measures: Sequence[Measure], spark: SparkSession) -> DataFrame:
    """Payments per (drug, category) and the category's share of the drug."""
    pay = [m for m in measures if m.measure not in CLAIM_MEASURES]
    t = measure_totals(facts, pay, spark).withColumnRenamed("measure", "category")
    drug_total = F.sum("amount").over(Window.partitionBy("drug"))
    return t.withColumn("share", F.try_divide(F.col("amount").cast("double"), drug_total.cast("double")))


def drug_measure_totals(facts: DataFrame, measures: Sequence[Measure], spark: SparkSession) -> DataFrame:
    """Total patients and claims per drug; a measure whose totals are all zero
    gives no rows (no chart)."""
    clm = [m for m in measures if m.measure in CLAIM_MEASURES]
    t = measure_totals(facts, clm, spark)
    grand = F.sum("amount").over(Window.partitionBy("measure"))
    return t.withColumn("_g", grand).where(F.col("_g") != 0).drop("_g")


def postal_format(registry: DataFrame) -> DataFrame:
    return registry.select("npi", format_postal("postal_code").alias("zip"))
