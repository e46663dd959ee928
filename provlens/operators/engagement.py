"""Engagement facts, their long form and their wide (pivoted) form.

Facts of all sources share one shape, ``facts(npi, drug, measure, amount,
patients, claims)``: a payment has a category in ``measure`` and dollars in
``amount``; a claim has no measure and counts in ``patients`` and ``claims``.
They are aggregated in this shape (no row is doubled to unpivot it first).

``engagement(npi, drug, measure, amount)`` is the long form, with measure
``Patients``, ``Claims`` or a payment category; it has no width limit. Wide
columns ``<drug>_<measure>`` are only made here, at the end, from an explicit
list (at most ``MAX_PIVOT_VALUES``) and never parsed back: cells are looked up
by (drug, measure), and names that would collide get a suffix.

The pivot is one ``groupBy("npi")`` with conditional sums: one shuffle on
``npi`` after map-side partial aggregation, so a provider with a huge number
of fact rows costs one partial row per map task. The activity total is one
more aggregate in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provlens.functions.normalise import sql_ident, sql_string
from provlens.operators import claims as C
from provlens.operators import payments as P
from provlens.plans.bounded import check_width, collect_names
from provlens.sources.selections import DEFAULT_CATEGORY, Selections

CLAIM_MEASURES = ("Patients", "Claims")
LONG_COLUMNS = ("npi", "drug", "measure", "amount")
LONG_SCHEMA = "npi bigint, drug string, measure string, amount bigint"
FACTS_SCHEMA = LONG_SCHEMA + ", patients bigint, claims bigint"
MEASURES_SCHEMA = "name string, drug string, measure string"


@dataclass(frozen=True)
class Measure:
    name: str
    drug: str
    measure: str


def wide_name(drug: str, measure: str) -> str:
    return f"{drug}_{measure}"


def named(pairs: Sequence[tuple[str, str]]) -> list[Measure]:
    """Measures with their column names. Two (drug, measure) pairs may join to
    one name, or to names that differ by case only, which Spark takes for one
    column; the second then gets the suffix ``__2`` and so on."""
    check_width(len(pairs))
    seen: dict[str, int] = {}
    out = []
    for drug, measure in pairs:
        name = wide_name(drug, measure)
        n = seen[name.lower()] = seen.get(name.lower(), 0) + 1
        out.append(Measure(name if n == 1 else f"{name}__{n}", drug, measure))
    return out


def resolve_names(columns: Sequence[str], known: Sequence[str]) -> list[Measure]:
    """The measures of wide columns from their names alone.

    A name is read as ``<drug>_<measure>`` with the longest known measure that
    it ends with (compared without case, spelt as known): ``A_OTHERS_GENERAL`` is
    drug ``A``, not ``A_OTHERS``. Where a shorter measure fits as well, the drugs
    of the names that fit one measure only decide: if they hold the drug of a
    shorter reading and not that of the longest, the shorter one is taken; if
    they hold both, the name is ambiguous. A name that ends with no known measure, an
    ambiguous one, and two names for one cell raise ``ValueError``.
    """
    spelt = {m.lower(): m for m in known}
    ways: dict[str, list[tuple[str, str]]] = {}
    for name in columns:
        low = name.lower()
        cuts = [i for i, c in enumerate(name) if c == "_" and i]
        ways[name] = [(name[:i], spelt[low[i + 1:]]) for i in cuts if low[i + 1:] in spelt]  # longest measure first
        if not ways[name]:
            raise ValueError(f"no known measure at the end of column {name!r}")
    sure = {w[0][0] for w in ways.values() if len(w) == 1}
    out, seen = [], {}
    for name, found in ways.items():
        backed = [w for w in found if w[0] in sure]
        if len(found) > 1 and len(backed) > 1:
            raise ValueError(f"column {name!r} can be read as {' or as '.join(f'{d} + {m}' for d, m in backed)}")
        drug, measure = (backed or found)[0] if len(found) > 1 else found[0]
        if (drug, measure) in seen:
            raise ValueError(f"columns {seen[drug, measure]!r} and {name!r} are one cell")
        seen[drug, measure] = name
        out.append(Measure(name, drug, measure))
    return out


def payment_pairs(sel: Selections) -> list[tuple[str, str]]:
    return [(d, c) for d in sel.payment_drugs() for c in sel.categories()]


def claim_pairs(sel: Selections) -> list[tuple[str, str]]:
    return [(d, m) for d in sel.claim_drugs() for m in CLAIM_MEASURES]


def payment_measures(sel: Selections) -> list[Measure]:
    return named(payment_pairs(sel))


def claim_measures(sel: Selections) -> list[Measure]:
    return named(claim_pairs(sel))


def all_measures(sel: Selections, payments: bool = True, claims: bool = True) -> list[Measure]:
    return named((payment_pairs(sel) if payments else []) + (claim_pairs(sel) if claims else []))


def measures_frame(spark: SparkSession, measures: Sequence[Measure]) -> DataFrame:
    """The (bounded) measure list as a table: name, drug, measure."""
    return spark.createDataFrame([(m.name, m.drug, m.measure) for m in measures], MEASURES_SCHEMA)


def measures_from(table: DataFrame) -> list[Measure]:
    """The measure list from its saved table."""
    return [Measure(r["name"], r["drug"], r["measure"]) for r in collect_names(table)]


def measure_table(sel: Selections, payments: bool = True, claims: bool = True) -> DataFrame:
    """The measure list as a plan over the selection tables (name, drug,
    measure), for any number of drugs: categories are one array, which every
    drug explodes."""
    parts = []
    if payments:
        renames = sel.category_map.where(F.col("renamed").isNotNull() & (F.col("renamed") != DEFAULT_CATEGORY))
        categories = renames.agg(F.collect_set("renamed")).scalar()
        parts.append(sel.drugs.select("drug").distinct().select(
            F.lit(0).alias("block"), "drug",
            F.explode(F.concat(categories, F.array(F.lit(DEFAULT_CATEGORY)))).alias("measure")))
    sources = [t.select("drug") for t in (sel.part_b, sel.part_d) if t is not None]
    if claims and sources:
        drugs = sources[0] if len(sources) == 1 else sources[0].unionByName(sources[1])
        parts.append(drugs.distinct().select(
            F.lit(1).alias("block"), "drug", F.explode(F.array(*[F.lit(m) for m in CLAIM_MEASURES])).alias("measure")))
    if not parts:
        return sel.drugs.sparkSession.createDataFrame([], MEASURES_SCHEMA)
    pairs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    name = F.concat_ws("_", "drug", "measure")
    same = Window.partitionBy(F.lower(name)).orderBy("block", "drug", "measure")
    return (pairs.withColumn("n", F.row_number().over(same))
            .select(F.when(F.col("n") == 1, name).otherwise(F.concat(name, F.lit("__"), F.col("n"))).alias("name"),
                    "drug", "measure"))


def facts(part_b: DataFrame | None, part_d: DataFrame | None, payments: DataFrame | None,
          sel: Selections) -> DataFrame:
    """Claim and payment facts in the common shape."""
    frames = []
    union = C.normalised_claims(part_b, part_d, sel)
    if union is not None:
        frames.append(claim_facts(union))
    if payments is not None:
        frames.append(payment_facts(P.payments_mapped(payments, sel)))
    if not frames:  # nothing selected: an empty table of the same shape
        return sel.drugs.sparkSession.createDataFrame([], FACTS_SCHEMA)
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def claim_facts(union: DataFrame) -> DataFrame:
    """Normalised claims in the common shape."""
    return union.select("npi", "drug", F.lit(None).cast("string").alias("measure"),
                        F.lit(None).cast("bigint").alias("amount"), "patients", "claims")


def payment_facts(mapped: DataFrame) -> DataFrame:
    """Mapped payments in the common shape."""
    none = F.lit(None).cast("bigint")
    return P.payments_long(mapped).select("npi", "drug", "measure", "amount", none.alias("patients"),
                                          none.alias("claims"))


def engagement_long(part_b: DataFrame | None, part_d: DataFrame | None, payments: DataFrame | None,
                    sel: Selections) -> DataFrame:
    """Union of claim facts and payment facts in the long shape."""
    frames = []
    union = C.normalised_claims(part_b, part_d, sel)
    if union is not None:
        frames.append(C.claims_long(union))
    if payments is not None:
        frames.append(P.payments_long(P.payments_mapped(payments, sel)))
    if not frames:  # nothing selected: an empty table of the same shape
        return sel.drugs.sparkSession.createDataFrame([], LONG_SCHEMA)
    out = frames[0].select(*LONG_COLUMNS)
    for f in frames[1:]:
        out = out.unionByName(f.select(*LONG_COLUMNS))
    return out


# Above this many measure columns the pivot aggregates by (npi, drug, measure)
# first and then reads the cells of sparse rows: O(1) work per fact row instead
# of one comparison per column, at the price of two more, much smaller shuffles.
NARROW_PIVOT_MAX = 64


def as_facts(rows: DataFrame) -> DataFrame:
    """Long rows (npi, drug, measure, amount) in the shape of facts."""
    if "patients" in rows.columns:
        return rows
    none = F.lit(None).cast("bigint")
    return rows.select("npi", "drug", "measure", "amount", none.alias("patients"), none.alias("claims"))


def _cell(m: Measure) -> Column:
    """The sum of one (drug, measure) cell: rows that carry the measure by
    name, and claim counts."""
    def total(value: str, condition: str) -> str:
        return f"sum(CASE WHEN drug = {sql_string(m.drug)} AND {condition} THEN {value} END)"

    parts = [total("amount", f"measure = {sql_string(m.measure)}")]
    if m.measure in CLAIM_MEASURES:
        parts.append(total(m.measure.lower(), "measure IS NULL"))
    cells = " + ".join(f"coalesce({p}, 0L)" for p in parts)
    return F.expr(f"CAST({cells} AS BIGINT) AS {sql_ident(m.name)}")


def _wanted(rows: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """Rows whose drug is on the list (each with the measures it may have)."""
    by_drug: dict[str, list[str]] = {}
    for m in measures:
        by_drug.setdefault(m.drug, []).append(m.measure)
    # bounded by MAX_PIVOT_VALUES; a local table, so no job
    lookup = F.broadcast(rows.sparkSession.createDataFrame(
        [(d, ms) for d, ms in by_drug.items()], "drug string, _measures array<string>"))
    own = F.col("measure").isNull() | F.array_contains("_measures", F.col("measure"))
    return rows.join(lookup, "drug").where(own)


def pivot_wide(rows: DataFrame, measures: Sequence[Measure], total: str | None = None,
               strategy: str = "auto") -> DataFrame:
    """One row per npi, one zero-filled column per measure.

    ``rows`` are facts or long rows; those outside the measure list are ignored
    (also by the total). ``strategy``: ``conditional`` (one groupBy, one
    shuffle, a conditional sum per column), ``two_phase`` (cells of the sparse
    rows) or ``auto`` (by width).
    """
    check_width(len(measures))
    if not measures:
        empty = rows.where(F.lit(False)).select("npi").distinct()
        return empty.withColumn(total, F.lit(0).cast("bigint")) if total else empty
    kept = _wanted(as_facts(rows), measures)
    names = {(m.drug, m.measure) for m in measures}
    counted = [m for m in CLAIM_MEASURES if any((d, m) in names for d in {x.drug for x in measures})]
    if strategy == "auto":
        strategy = "conditional" if len(measures) <= NARROW_PIVOT_MAX else "two_phase"
    if strategy == "conditional":
        every = " + ".join(["coalesce(sum(amount), 0L)"] + [
            f"coalesce(sum(CASE WHEN measure IS NULL AND array_contains(_measures, {sql_string(m)}) "
            f"THEN {m.lower()} END), 0L)" for m in counted])
        aggs = [F.expr(f"CAST({every} AS BIGINT) AS {sql_ident(total)}")] if total else []
        return kept.groupBy("npi").agg(*aggs, *[_cell(m) for m in measures])
    # cells are read from one map column: an expression over all cells beside the named ones would make the
    # optimizer list every mixture of both
    sparse = sparse_wide(kept, measure_index(rows.sparkSession, measures))
    cells = [F.expr(f"coalesce(try_element_at(cells, {i}), 0L) AS {sql_ident(m.name)}") for i, m in enumerate(measures)]
    return sparse.select("npi", *([F.col("total").alias(total)] if total else []), *cells)


def fact_sums(rows: DataFrame) -> DataFrame:
    """Facts summed by (npi, drug, measure), in the shape of facts."""
    return as_facts(rows).groupBy("npi", "drug", "measure").agg(
        *[F.sum(c).alias(c) for c in ("amount", "patients", "claims")])


INDEX_SCHEMA = "drug string, m string, i int"


def measure_index(spark: SparkSession, measures: Sequence[Measure]) -> DataFrame:
    """The measure list with the place of each measure in it."""
    return spark.createDataFrame([(m.drug, m.measure, i) for i, m in enumerate(measures)], INDEX_SCHEMA)


def sparse_wide(rows: DataFrame, index: DataFrame) -> DataFrame:
    """One sparse row per npi: (npi, total, cells), the cells a map from a
    measure's place in ``index`` (drug, m, i) to its sum. It has no width limit:
    a measure takes room only where a provider has it. The index is joined as
    Spark sees fit (it is as long as the measure list)."""
    sums = fact_sums(rows)
    cells = F.when(F.col("measure").isNotNull(), F.array(F.struct(F.col("measure").alias("m"), F.col("amount").alias("v")))
                   ).otherwise(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m.lower()).alias("v"))
                                         for m in CLAIM_MEASURES]))
    flat = sums.select("npi", "drug", F.inline(cells)).where(F.col("v").isNotNull())
    one = flat.join(index, ["drug", "m"]).groupBy("npi", "i").agg(F.sum("v").alias("v"))
    return one.groupBy("npi").agg(F.sum("v").alias("total"),
                                  F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("cells"))


def _row_amount(measures_known: bool) -> str:
    if not measures_known:
        return "coalesce(amount, 0L) + coalesce(patients, 0L) + coalesce(claims, 0L)"
    counts = " + ".join(f"CASE WHEN array_contains(_measures, {sql_string(m)}) THEN coalesce({m.lower()}, 0L) "
                        "ELSE 0L END" for m in CLAIM_MEASURES)
    return f"coalesce(amount, 0L) + {counts}"


def activity_totals(rows: DataFrame, measures: Sequence[Measure] | None = None) -> DataFrame:
    """npi, total over all measures, kept when total > 0 (negatives and
    cancelling values drop out, as in the reference)."""
    df = as_facts(rows)
    if measures is not None:
        df = _wanted(df, measures)
    return (df.groupBy("npi").agg(F.expr(f"CAST(sum({_row_amount(measures is not None)}) AS BIGINT)").alias("total"))
            .where(F.col("total") > 0))


def totals_by_measure(rows: DataFrame) -> DataFrame:
    """(drug, measure, amount) of facts: sums per (drug, measure) first, the
    few results are then unpivoted."""
    sums = (as_facts(rows).groupBy("drug", "measure")
            .agg(*[F.sum(c).alias(c) for c in ("amount", "patients", "claims")]))
    cells = F.when(F.col("measure").isNotNull(), F.array(F.struct(F.col("measure").alias("m"), F.col("amount").alias("v")))
                   ).otherwise(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m.lower()).alias("v"))
                                         for m in CLAIM_MEASURES]))
    return sums.select("drug", F.inline(cells)).select("drug", F.col("m").alias("measure"), F.col("v").alias("amount"))


def engagement_outer(part_b: DataFrame | None, part_d: DataFrame | None, payments: DataFrame | None,
                     sel: Selections) -> DataFrame:
    """Every provider with payments or claims, zeros where one of them is
    missing: the full outer join of the two wide tables, as one pivot of the
    stacked facts (one shuffle on npi; a key is there once, from either side)."""
    sel.prefetch()
    claims = part_b is not None or part_d is not None
    rows = facts(part_b, part_d, payments, sel)
    return pivot_wide(rows, all_measures(sel, payments=payments is not None, claims=claims))


def merge_wide(payments_wide: DataFrame, claims_wide: DataFrame) -> DataFrame:
    """Full outer join on npi of two wide tables that exist already, measures
    filled with 0."""
    measure_cols = [c for c in payments_wide.columns + claims_wide.columns if c != "npi"]
    return payments_wide.join(claims_wide, "npi", "full").fillna(0, subset=measure_cols)


def wide_to_long(wide: DataFrame, measures: Sequence[Measure], spark: SparkSession,
                 key: str = "npi", keep_zero: bool = False) -> DataFrame:
    """Unpivot wide measure columns back to (npi, drug, measure, amount).

    Drug and measure come from the measure list (a small broadcast table),
    never from splitting the column name.
    """
    names = [m.name for m in measures]
    cols = [F.col(sql_ident(n)) for n in names]  # quoted: names may hold '.', '(' ...
    long = wide.select(key, *[c.cast("bigint").alias(n) for c, n in zip(cols, names)]) \
        .unpivot([key], [F.col(sql_ident(n)) for n in names], "name", "amount")
    if not keep_zero:
        long = long.where(F.col("amount") != 0)
    lookup = F.broadcast(measures_frame(spark, measures))  # bounded by MAX_PIVOT_VALUES
    return long.join(lookup, "name").select(key, "drug", "measure", "amount")
