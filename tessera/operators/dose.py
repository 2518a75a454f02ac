"""Dose and concentration conversions and endpoint profiles (PR16-PR19, ML18)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: hazard class upper bounds in mg/L (class above 100 mg/L is undefined -> NULL)
HAZARD_BOUNDS = [(1.0, 1), (10.0, 2), (100.0, 3)]
TOXIC_AT = 0.5


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def neglog_to_mgkg(p: Column | str, mw: Column | str) -> Column:
    """PR16: 10^(-p) mol/kg * MW g/mol * 1000 = mg/kg."""
    return F.pow(F.lit(10.0), -_c(p)) * _c(mw) * 1000.0


def mgkg_to_neglog(mgkg: Column | str, mw: Column | str) -> Column:
    """PR16 inverse: -log10(mg/kg / 1000 / MW); NULL for a molecular weight of 0."""
    return -F.log10(F.try_divide(_c(mgkg) / 1000.0, _c(mw)))


def neglog_to_mmol_l(p: Column | str) -> Column:
    """PR17: mmol/L = 10^(-p) * 1000."""
    return F.pow(F.lit(10.0), -_c(p)) * 1000.0


def mmol_to_mg_l(mmol: Column | str, mw: Column | str) -> Column:
    """PR17: mg/L = mmol/L * MW."""
    return _c(mmol) * _c(mw)


def hazard_class(mg_l: Column | str) -> Column:
    """PR18: <=1 -> 1, <=10 -> 2, <=100 -> 3; above 100 undefined (NULL)."""
    x = _c(mg_l)
    expr = None
    for bound, cls in HAZARD_BOUNDS:
        expr = F.when(x <= bound, cls) if expr is None else expr.when(x <= bound, cls)
    return expr


def toxic_label(prob: Column | str) -> Column:
    """PR19: probability >= 0.5 -> 'Toxic', else 'Nontoxic' (missing stays missing)."""
    p = _c(prob)
    return F.when(p >= TOXIC_AT, "Toxic").when(p.isNotNull(), "Nontoxic")


def aquatic_profile(df: DataFrame, mw: str, species: Sequence[str]) -> DataFrame:
    """PR17/PR18: per species mmol/L and mg/L, the worst (lowest) mg/L over
    species and its hazard class."""
    out = df
    for s in species:
        out = out.withColumn(f"{s}_mmol_l", neglog_to_mmol_l(s)) \
                 .withColumn(f"{s}_mg_l", mmol_to_mg_l(f"{s}_mmol_l", mw))
    worst = F.least(*[F.col(f"{s}_mg_l") for s in species])
    return out.withColumn("worst_mg_l", worst).withColumn("hazard_class", hazard_class("worst_mg_l"))


def endpoint_profile(df: DataFrame, id_col: str, endpoints: Sequence[str],
                     flags: Sequence[str] = ()) -> DataFrame:
    """ML18: long table entities x endpoints (id, endpoint, value) plus flags."""
    return df.select(id_col, *flags, *[F.col(e).cast("double").alias(e) for e in endpoints]) \
        .unpivot([id_col, *flags], list(endpoints), "endpoint", "value")
