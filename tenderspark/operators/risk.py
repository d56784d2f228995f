"""Red-flag scores for all companies in one plan: concentration, repeat pairs, market deviation, award bursts, blend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import band, cpv_division, final_expr, is_framework, money, value_expr
from ..functions.dealing import dealt
from ..streaming.ingest import checkpointed
from .spend import market_cpv

#: Thresholds of the flags; fixed values.
HHI_BANDS, MIN_SUPPLIERS, MIN_SUPPLIER_VALUE = (0.15, 0.25), 5, 100_000.0
PAIR_BANDS, MIN_COUNTERPARTIES, MIN_PAIR_VALUE, SUPPLIER_SIDE_FACTOR = (0.50, 0.75), 3, 50_000.0, 0.5
DEVIATION_MULTIPLE, MARKET_MIN = 3.0, 20
BURST, BURST_DAYS, VALUE_FLOOR, CEILING_BAND = 4, 30, 10_000.0, (0.7, 1.0)
CEILING, CEILING_WORKS, WORKS_DIVISION = 180_000.0, 300_000.0, "45"
WEIGHTS = {"concentration": 0.30, "pair": 0.25, "market": 0.25, "cluster": 0.20}
RISK_BANDS = (30.0, 60.0)

#: Columns of notices that the flags use.
USED = ("notice_id", "procurer_ico", "cpv_code", "procedure_type", "final_value", "estimated_value", "award_date", "publication_date")
DISCLAIMER = "Statistical observations over published records; they call for a look at the files and prove nothing by themselves."


def meetings(notices: DataFrame, awards: DataFrame) -> DataFrame:
    """Each named supplier of each notice once, with the number of its awards in `_k` and the notice's columns."""
    dealt_ = dealt(awards.where("supplier_ico IS NOT NULL"), awards.count(), "notice_id")
    named = dealt_.groupBy("notice_id", "supplier_ico").agg(F.count(F.lit(1)).alias("_k"))
    return named.join(notices, "notice_id")


def materialised(notices: DataFrame, awards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The notices' columns that the flags use, and the meetings, each written once: the one join that all flags share."""
    known = checkpointed(notices.select(*[c for c in USED if c in notices.columns]))
    return known, checkpointed(meetings(known, awards))


def pairs(met: DataFrame, rows: int | None = None) -> DataFrame:
    """(ico, counterparty, role, n, total): all counterparties of all companies, dealt by company; `role` is the
    counterparty's. As a supplier a company meets a procurer once a notice, as a procurer it meets a supplier once an award.
    `rows`: about how many meetings there are (none: they are counted)."""
    rows = met.count() if rows is None else rows
    per = met.where("supplier_ico <> ''").select("supplier_ico", "procurer_ico", "_k", final_expr().alias("v"))
    of_all = F.sum(F.col("v").cast("decimal(18,2)") * F.col("_k")).cast("double")
    by = dealt(per, rows, "supplier_ico", "procurer_ico").groupBy("supplier_ico", "procurer_ico").agg(F.count(F.lit(1)).alias("n"), money("v").alias("total"), F.sum("_k").alias("k"), of_all.alias("vk"))
    sides = F.array(
        F.struct(F.col("supplier_ico").alias("ico"), F.col("procurer_ico").alias("counterparty"), F.lit("procurer").alias("role"), F.col("n").alias("n"), F.col("total").alias("total")),
        F.struct(F.col("procurer_ico").alias("ico"), F.col("supplier_ico").alias("counterparty"), F.lit("supplier").alias("role"), F.col("k").alias("n"), F.col("vk").alias("total")),
    )
    return dealt(by.select(F.explode(sides).alias("s")).select("s.*").where("ico IS NOT NULL"), 2 * rows, "ico")


def concentration_flag(pairs_: DataFrame) -> DataFrame:
    rows = pairs_.where("role = 'supplier'").withColumn("p", F.when(F.col("total") > 0, F.col("total")).otherwise(0.0))
    by = rows.groupBy("ico").agg(F.count_if(F.col("p") > 0).alias("suppliers"), money("p").alias("value"), F.sum(F.col("p") * F.col("p")).alias("q"), F.max("p").alias("top"))
    hhi = F.when(F.col("value") > 0, F.round(F.col("q") / (F.col("value") * F.col("value")), 4)).otherwise(0.0)
    by = by.withColumns({"hhi": hhi, "top_share": F.when(F.col("value") > 0, F.round(F.col("top") / F.col("value"), 4)).otherwise(0.0), "material": (F.col("suppliers") >= MIN_SUPPLIERS) & (F.col("value") >= MIN_SUPPLIER_VALUE)})
    return by.select("ico", "suppliers", "value", "hhi", "top_share", F.when(F.col("material"), band(F.col("hhi"), *HHI_BANDS)).otherwise("informational").alias("severity"), F.when(F.col("material"), F.round(F.col("hhi").cast("decimal(9,4)") * 100, 1).cast("double")).otherwise(0.0).alias("score"), (F.col("material") & (F.col("hhi") >= HHI_BANDS[1])).alias("triggered"))


def pair_flag(pairs_: DataFrame) -> DataFrame:
    by = pairs_.groupBy("ico").agg(F.count(F.lit(1)).alias("counterparties"), money("total").alias("value"), F.sum("n").alias("contracts"), F.max(F.struct("total", "n", F.coalesce("counterparty", F.lit("")).alias("counterparty"), "role")).alias("top"))
    share = F.when(F.col("value") > 0, F.col("top.total") / F.col("value"))
    by = by.withColumns({"share": share, "material": (F.col("counterparties") >= MIN_COUNTERPARTIES) & (F.col("value") >= MIN_PAIR_VALUE)})
    return by.select(
        "ico", "counterparties", "value", F.when(F.col("value") > 0, F.col("top.counterparty")).alias("top"), F.round("share", 4).alias("value_share"), F.round(F.col("top.n") / F.col("contracts"), 4).alias("count_share"),
        F.when(F.col("value") > 0, F.when(F.col("top.role") == "procurer", "supplier").otherwise("procurer")).alias("subject_role"),
        F.when(F.col("material"), band(F.col("share"), *PAIR_BANDS)).otherwise("informational").alias("severity"), F.when(F.col("material"), F.round(F.col("share") * 100, 1)).otherwise(0.0).alias("score"), (F.col("material") & (F.col("share") >= PAIR_BANDS[0])).alias("triggered"),
    )


def market_flag(notices: DataFrame, met: DataFrame, rows: int | None = None) -> DataFrame:
    """The worst multiple of a company's mean value in a category over the market's median (or mean, were that 0). A company
    counts once in a notice, in whatever role. `rows`: about how many notices and meetings there are (none: counted)."""
    rows = met.count() + notices.count() if rows is None else rows
    baseline = F.when(F.col("median") > 0, F.col("median")).when(F.col("total") > 0, F.col("total") / F.col("n"))
    market = market_cpv(notices).where(F.col("n") >= MARKET_MIN).select("cpv_code", baseline.alias("baseline")).where("baseline IS NOT NULL")
    columns = ("cpv_code", final_expr().alias("v"))
    won = met.where("cpv_code IS NOT NULL AND NOT supplier_ico <=> procurer_ico").select(F.col("supplier_ico").alias("ico"), *columns)
    gave = notices.where("cpv_code IS NOT NULL AND procurer_ico IS NOT NULL").select(F.col("procurer_ico").alias("ico"), *columns)
    own = dealt(won.unionByName(gave), rows, "ico", "cpv_code").groupBy("ico", "cpv_code").agg(F.count(F.lit(1)).alias("n"), money("v").alias("total"))
    compared = own.join(F.broadcast(market), "cpv_code").withColumn("multiple", F.round(F.col("total") / F.col("n") / F.col("baseline"), 2))
    by = compared.groupBy("ico").agg(F.max("multiple").alias("multiple"), F.count(F.lit(1)).alias("compared"))
    return by.select("ico", "multiple", "compared", F.round(F.least(F.lit(100.0), F.col("multiple") / DEVIATION_MULTIPLE * 50.0), 1).alias("score"), F.when(F.col("multiple") >= 2 * DEVIATION_MULTIPLE, "high").when(F.col("multiple") >= DEVIATION_MULTIPLE, "moderate").otherwise("low").alias("severity"), (F.col("multiple") >= DEVIATION_MULTIPLE).alias("triggered"))


def timeline(met: DataFrame) -> DataFrame:
    """(ico, counterparty, date, cpv_code, value): dated awards of both roles outside framework procedures; a procurer's row
    for each award, a supplier's for each notice."""
    dated = met.where(~is_framework()).withColumns({"value": value_expr(), "date": F.coalesce("award_date", "publication_date")}).where("date IS NOT NULL AND procurer_ico IS NOT NULL")
    columns = ("date", "cpv_code", "value")
    won = dated.select(F.col("supplier_ico").alias("ico"), F.col("procurer_ico").alias("counterparty"), *columns)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k"))).alias("_award")
    gave = dated.select(F.col("procurer_ico").alias("ico"), F.col("supplier_ico").alias("counterparty"), *columns, each).drop("_award")
    return won.unionByName(gave)


def bursts(series: DataFrame, rows: int | None = None) -> DataFrame:
    """Per (ico, counterparty): the densest window of 30 days, the earliest among equals, and its score. Rows of a pair are
    ordered in a range frame, so no state is built in Python. `rows`: about how many there are (none: they are counted)."""
    size = series.count() if rows is None else rows
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    dated = series.select("ico", "counterparty", day.alias("day"), cpv_division().alias("division"), F.col("value").cast("decimal(18,2)").alias("value"))
    w = Window.partitionBy("ico", "counterparty").orderBy("day").rangeBetween(-BURST_DAYS, 0)
    framed = dealt(dated, size, "ico", "counterparty").select("ico", "counterparty", "day", F.count(F.lit(1)).over(w).alias("n"), F.sum("value").over(w).alias("value"), F.min("day").over(w).alias("first"), F.min("division").over(w).alias("low"), F.max("division").over(w).alias("top"))
    best = framed.groupBy("ico", "counterparty").agg(F.count(F.lit(1)).alias("awards"), F.max(F.struct("n", (-F.col("day")).alias("minus"), "value", "first", "low", "top")).alias("b"))
    n, value = F.col("b.n"), F.col("b.value").cast("double")
    shared, dense = F.coalesce(F.col("b.low") == F.col("b.top"), F.lit(False)), n >= BURST
    ceiling = F.when(F.col("b.low") == WORKS_DIVISION, CEILING_WORKS).otherwise(CEILING)
    near = dense & shared & (value >= VALUE_FLOOR) & value.between(CEILING_BAND[0] * ceiling, CEILING_BAND[1] * ceiling)
    base = F.round(F.least(F.lit(100.0), n / BURST * 60.0), 1)
    return best.select(
        "ico", "counterparty", "awards", n.alias("burst"), value.alias("window_value"), F.when(n > 1, F.date_add(F.lit("1970-01-01").cast("date"), F.col("b.first"))).alias("first_day"), F.when(n > 1, F.date_add(F.lit("1970-01-01").cast("date"), -F.col("b.minus"))).alias("last_day"),
        F.when(shared, F.col("b.low")).alias("division"), near.alias("near_ceiling"), (dense & shared).alias("triggered"),
        F.when(dense & ~shared, F.round(base * 0.5, 1)).otherwise(base).alias("score"), F.when(~dense, "low").when(~shared, "informational").when(near | (n >= 2 * BURST), "high").otherwise("moderate").alias("severity"),
    )


def cluster_flag(met: DataFrame, rows: int, *more: str) -> DataFrame:
    """Each company's worst burst by score, with `more` of its columns; `rows`: about how many awards the meetings hold."""
    found = dealt(bursts(timeline(met), 2 * rows), 2 * rows, "ico")
    return found.groupBy("ico").agg(F.max(F.struct("score", "counterparty", "burst", "severity", "triggered", *more)).alias("w")).select("ico", "w.*")


def risk_profiles(notices: DataFrame, awards: DataFrame) -> DataFrame:
    """Per company: the four flags' scores, the weighted score, its band and the triggered flags."""
    known, met = materialised(notices, awards)
    rows = met.count()
    p = pairs(met, rows)
    flags = {"concentration": concentration_flag(p), "pair": pair_flag(p), "market": market_flag(known, met), "cluster": cluster_flag(met, rows)}
    parts = None
    for name, df in flags.items():
        one = df.select("ico", F.lit(name).alias("flag"), "score", "triggered", *([F.col("subject_role")] if name == "pair" else [F.lit(None).cast("string").alias("subject_role")]))
        parts = one if parts is None else parts.unionByName(one)
    by = parts.groupBy("ico").agg(*[F.coalesce(F.max(F.when(F.col("flag") == f, F.col("score"))), F.lit(0.0)).alias(f) for f in flags], F.max("subject_role").alias("subject_role"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("triggered"), F.col("flag")))), ",").alias("triggered"))
    # whole tenths and thousandths, so that ties are exact and round up
    pair = F.when(F.col("subject_role") == "supplier", round(1000 * WEIGHTS["pair"] * SUPPLIER_SIDE_FACTOR)).otherwise(round(1000 * WEIGHTS["pair"])).cast("long")
    tenths = {f: F.round(F.col(f) * 10).cast("long") for f in flags}
    parts = sum((tenths[f] * F.lit(round(1000 * WEIGHTS[f])).cast("long") for f in flags if f != "pair"), tenths["pair"] * pair)
    whole = pair + F.lit(round(1000 * (1 - WEIGHTS["pair"]))).cast("long")
    by = by.withColumns({"_parts": parts, "_whole": whole})
    score = F.expr("(2 * _parts + _whole) div (2 * _whole)").cast("double") / 10
    return by.withColumn("risk_score", score).drop("_parts", "_whole").withColumn("risk_band", band(F.col("risk_score"), *RISK_BANDS))
