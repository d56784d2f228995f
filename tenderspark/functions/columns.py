"""Measures and derived columns that every read model shares (money is summed as decimals, so sums do not depend on order)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of procedures that burst scoring leaves out; fixed values.
FRAMEWORK_MARKS = ("rámc", "framework", "dynamick", "dynamic purchasing", "dns")
#: English names of category codes; fixed values.
CPV_LABELS = {
    "03000000": "Agricultural, forestry, fishing products and related products",
    "09000000": "Petroleum products, fuel, electricity and other sources of energy",
    "30000000": "Transport equipment and auxiliary products to transportation",
    "30200000": "Land vehicles including component and spare parts",
    "33000000": "Medical equipments, pharmaceutical products",
    "39150000": "Cleaning and hygiene services",
    "45000000": "Construction work",
    "45100000": "Building and related construction work",
    "45200000": "Civil engineering work",
    "45300000": "Specialized construction works",
    "50000000": "Repair and installation services of machinery and equipment",
    "55000000": "Hotel and restaurant and catering services",
    "60000000": "Transport services by land, water, air",
    "65000000": "Financial and insurance services",
    "66000000": "Real estate services",
    "70000000": "Professional services: legal services, management consultancy",
    "71000000": "Architectural and engineering services",
    "72000000": "IT services: computer programming, consultancy and related services",
    "79000000": "Business and management consultancy services; related services",
    "80000000": "Education and training services",
    "80100000": "Primary and secondary education services",
    "80200000": "Higher education services",
    "85000000": "Health and social services",
    "85100000": "Health services",
    "85200000": "Social services",
    "90000000": "Sewage, waste, water and environmental services",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """An exact sum of amounts, as a double."""
    return F.sum(col(c).cast("decimal(18,2)")).cast("double")


def total(c: Column | str) -> Column:
    return F.coalesce(money(c), F.lit(0.0))


def value_expr(final: str = "final_value", estimated: str = "estimated_value") -> Column:
    return F.coalesce(F.col(final), F.col(estimated), F.lit(0.0))


def final_expr(final: str = "final_value") -> Column:
    return F.coalesce(F.col(final), F.lit(0.0))


def date_expr() -> Column:
    return F.coalesce(F.col("award_date"), F.col("publication_date"))


def year_str() -> Column:
    return F.coalesce(F.substring(date_expr().cast("string"), 1, 4), F.lit("0000"))


def year_from_date(date: Column | str, now_year: int) -> Column:
    y = F.substring(col(date).cast("string"), 1, 4).try_cast("int")
    return F.when(y.between(1993, now_year + 5), y).otherwise(0)


def status_from_year(year: Column | str) -> Column:
    return F.when(col(year) >= 2024, "active").otherwise("closed")


def cpv_prefix(code: Column | str = "cpv_code") -> Column:
    c = F.coalesce(col(code), F.lit(""))
    return F.rpad(F.substring(F.regexp_replace(c, "[- ]", ""), 1, 8), 8, "0")


def cpv_division(code: Column | str = "cpv_code") -> Column:
    return F.when(F.length(col(code)) >= 2, F.substring(col(code), 1, 2))


def cpv_label(code: Column) -> Column:
    """The label of a code; a code without one is its own label."""
    labels = F.create_map(*[F.lit(x) for pair in CPV_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, code), code)


def is_framework(procedure: Column | str = "procedure_type") -> Column:
    p = F.lower(F.coalesce(col(procedure), F.lit("")))
    found = F.lit(False)
    for mark in FRAMEWORK_MARKS:
        found = found | p.contains(mark)
    return found


def date_prefix(c: Column | str) -> Column:
    """A date from the first ten characters, else null."""
    return F.try_to_date(F.substring(col(c), 1, 10), "yyyy-MM-dd")


def safe_double(c: Column | str) -> Column:
    return col(c).try_cast("double")


def band(score: Column, moderate: float, high: float) -> Column:
    return F.when(score >= high, "high").when(score >= moderate, "moderate").otherwise("low")


def clamp_date(c: Column | str, now_year: int, first_year: int = 1995) -> Column:
    d = col(c)
    return F.when(F.year(d).between(first_year, now_year + 5), d)


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def to_iso_z(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_timestamp(c: Column | str) -> Column:
    """Timestamps with or without a closing Z, as wall time in UTC."""
    t = F.regexp_replace(F.regexp_replace(col(c), "Z$", ""), "T", " ")
    return t.try_cast("timestamp_ntz")


def human_age(seconds: Column) -> Column:
    """Ages as days, hours or minutes."""
    s = seconds.cast("long")
    days, hours, minutes = (F.floor(s / n).cast("string") for n in (86400, 3600, 60))
    return F.when(s.isNull(), "never").when(s >= 86400, F.concat(days, F.lit("d"))).when(s >= 3600, F.concat(hours, F.lit("h"))).otherwise(F.concat(minutes, F.lit("m")))
