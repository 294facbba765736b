"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import checks
from ledgerloom.fixed_values import SENSITIVITY
from ledgerloom.functions import amounts, dates, labels, robust
from ledgerloom.operators import adhoc, anomalies, comparison
from ledgerloom.plans.composites import scanned
from ledgerloom.plans.model_sql import anomalies_sql, rounded
from ledgerloom.plans.registry import query
from ledgerloom.plans.samples import PERIOD_A, PERIOD_B, WHOLE, api_pages
from ledgerloom.sources import sample_tables as tables

def _day():
    return F.col("usage_date")



def _usage(spark, sf):
    """Usage dates of every line item."""
    rows = tables.line_items(spark, sf, ["usage_start_date"])
    return rows.select(dates.to_day(F.col("usage_start_date")).alias("usage_date"))


def _counted(rows, **columns):
    return rows.groupBy(*[c.alias(name) for name, c in columns.items()]).agg(
        F.count("*").alias("line_items")
    )


@query("SELECT usage_date, COUNT(*) AS line_items FROM line_items GROUP BY 1", text=("usage_date",))
def to_day(spark, sf):
    return _counted(_usage(spark, sf), usage_date=_day())


@query(
    """SELECT CAST(date_trunc('week', usage_date) AS DATE) AS week,
       CAST(date_trunc('month', usage_date) AS DATE) AS month, COUNT(*) AS line_items
FROM line_items GROUP BY 1, 2""",
    text=("week", "month"),
)
def trunc_period(spark, sf):
    return _counted(
        _usage(spark, sf),
        week=dates.trunc_period(_day(), "week"),
        month=dates.trunc_period(_day(), "month"),
    )


@query(
    """SELECT usage_date - 14 AS before, usage_date + 7 AS after, COUNT(*) AS line_items
FROM line_items GROUP BY 1, 2""",
    text=("before", "after"),
)
def date_add_days(spark, sf):
    return _counted(
        _usage(spark, sf), before=F.date_sub(_day(), 14), after=F.date_add(_day(), 7)
    )


@query(
    """SELECT CAST(d AS DATE) AS day, COUNT(*) AS billing_periods
FROM (SELECT DISTINCT billing_period_start AS s, billing_period_end AS e FROM line_items),
     LATERAL (SELECT unnest(generate_series(s, e, INTERVAL 1 DAY)) AS d)
GROUP BY 1""",
    text=("day",),
)
def date_range(spark, sf):
    """Every date of every billing period, both ends included."""
    periods = tables.line_items(spark, sf, ["billing_period_start", "billing_period_end"]).distinct()
    days = dates.date_range(F.col("billing_period_start"), F.col("billing_period_end"))
    return periods.select(F.explode(days).alias("day")).groupBy("day").agg(
        F.count("*").alias("billing_periods")
    )


@query(
    "SELECT billing_period_start AS month, COUNT(*) AS line_items FROM line_items GROUP BY 1",
    text=("month",),
)
def month_start(spark, sf):
    return _counted(_usage(spark, sf), month=dates.month_start(_day()))


@query("SELECT billing_period, COUNT(*) AS line_items FROM line_items GROUP BY 1")
def billing_period_str(spark, sf):
    return _counted(_usage(spark, sf), billing_period=dates.billing_period(_day()))


@query(
    """SELECT billing_period, billing_period_start AS period_start, COUNT(*) AS line_items
FROM line_items GROUP BY 1, 2""",
    text=("period_start",),
)
def period_start_parse(spark, sf):
    period = dates.billing_period(_day())
    return _counted(
        _usage(spark, sf), billing_period=period, period_start=dates.period_start(period)
    )


@query(
    """SELECT usage_type, COALESCE(SUM(CASE WHEN resource_id IS NOT NULL AND operation = 'F'
         THEN net_unblended_cost END), 0) AS cost
FROM line_items GROUP BY 1"""
)
def coalesce_zero(spark, sf):
    rows = tables.line_items(
        spark, sf, ["usage_type", "resource_id", "operation", "net_unblended_cost"]
    )
    wanted = F.col("resource_id").isNotNull() & (F.col("operation") == "F")
    return rows.groupBy("usage_type").agg(
        amounts.coalesce_zero(F.sum(F.when(wanted, F.col("net_unblended_cost")))).alias("cost")
    )


_PERIOD_COSTS = f"""costs AS (
  SELECT usage_account_id AS group_value,
         COALESCE(SUM(total_net_amortized_cost) FILTER (
           WHERE usage_date BETWEEN DATE '{PERIOD_A[0]}' AND DATE '{PERIOD_A[1]}'), 0) AS a_cost,
         COALESCE(SUM(total_net_amortized_cost) FILTER (
           WHERE usage_date BETWEEN DATE '{PERIOD_B[0]}' AND DATE '{WHOLE[1]}'), 0) AS b_cost
  FROM summary GROUP BY 1)"""


def _period_costs(spark, sf):
    rows = tables.summary_rows(spark, sf, ["usage_account_id"])
    return comparison.period_costs(
        rows, PERIOD_A, (PERIOD_B[0], WHOLE[1]), group_by="usage_account_id"
    )


@query(
    f"""WITH {_PERIOD_COSTS}
SELECT group_value, CASE WHEN a_cost <> 0 THEN (b_cost - a_cost) / a_cost * 100 END AS pct_change
FROM costs"""
)
def pct_change(spark, sf):
    change = F.col("b_cost") - F.col("a_cost")
    return _period_costs(spark, sf).select(
        "group_value", amounts.pct_change(change, F.col("a_cost")).alias("pct_change")
    )


@query(
    f"""WITH {_PERIOD_COSTS}
SELECT group_value, {rounded("CASE WHEN a_cost + b_cost <> 0 THEN b_cost / (a_cost + b_cost) * 100 ELSE 0.0 END", 1)}
  AS pct_of_total FROM costs"""
)
def pct_of_total(spark, sf):
    share = amounts.pct_of_total(F.col("b_cost"), F.col("a_cost") + F.col("b_cost"))
    return _period_costs(spark, sf).select(
        "group_value", amounts.display_round(share, 1).alias("pct_of_total")
    )


def _round_sql(digits: int) -> str:
    return f"""SELECT usage_date, product_code, {rounded("cost / 7", digits)} AS shown
FROM daily_product"""


def _round_shown(spark, sf, digits: int):
    daily = tables.summary_rows(spark, sf, ["product_code"]).groupBy("usage_date", "product_code")
    return daily.agg(
        amounts.display_round(F.sum("total_net_amortized_cost") / 7, digits).alias("shown")
    )


@query(_round_sql(1), text=("usage_date",))
def round1(spark, sf):
    return _round_shown(spark, sf, 1)


@query(_round_sql(2), text=("usage_date",))
def round2(spark, sf):
    return _round_shown(spark, sf, 2)


@query(_round_sql(4), text=("usage_date",))
def round4(spark, sf):
    return _round_shown(spark, sf, 4)


_WITH_MEDIAN = """centred AS (
  SELECT product_code, usage_date, cost, MEDIAN(cost) OVER (PARTITION BY product_code) AS m
  FROM daily_product),
scored AS (
  SELECT *, MEDIAN(abs(cost - m)) OVER (PARTITION BY product_code) AS mad FROM centred),
z AS (
  SELECT product_code, usage_date,
         CASE WHEN mad >= 1e-10 THEN 0.6745 * (cost - m) / mad
              WHEN abs(cost - m) <= 1.0 THEN 0.0 WHEN cost > m THEN 10.0 ELSE -10.0 END AS z
  FROM scored)"""


def _day_scores(spark, sf):
    """Every product and day scored against the product's whole history.

    Two grouped medians joined back on the product: the history of a product is
    one value per calendar day.
    """
    daily = tables.summary_rows(spark, sf, ["product_code"]).groupBy(
        "product_code", "usage_date"
    ).agg(F.sum("total_net_amortized_cost").alias("cost"))
    centred = daily.join(
        daily.groupBy("product_code").agg(F.median("cost").alias("m")), "product_code"
    )
    deviation = F.abs(F.col("cost") - F.col("m"))
    scored = centred.join(
        centred.groupBy("product_code").agg(F.median(deviation).alias("mad")), "product_code"
    )
    z = F.expr(robust.robust_z("cost", "m", "mad", 1.0))
    return scored.select("product_code", "usage_date", z.alias("z"))


@query(f"WITH {_WITH_MEDIAN} SELECT * FROM z", text=("usage_date",))
def robust_z(spark, sf):
    return _day_scores(spark, sf)


@query(
    f"""WITH {_WITH_MEDIAN}
SELECT CASE WHEN abs(z) > 4 THEN 'critical' WHEN abs(z) > 3 THEN 'warning' ELSE 'info' END
         AS severity, COUNT(*) AS days FROM z GROUP BY 1"""
)
def severity_point(spark, sf):
    severity = F.expr(robust.point_severity("z"))
    return _day_scores(spark, sf).groupBy(severity.alias("severity")).agg(F.count("*").alias("days"))


@query(
    f"""WITH {_WITH_MEDIAN}
SELECT CASE WHEN abs(z) > 1.0 THEN 'critical' WHEN abs(z) > 0.5 THEN 'warning' ELSE 'info' END
         AS severity, COUNT(*) AS days FROM z GROUP BY 1"""
)
def severity_drift(spark, sf):
    severity = F.expr(robust.drift_severity("z"))
    return _day_scores(spark, sf).groupBy(severity.alias("severity")).agg(F.count("*").alias("days"))


@query(
    f"""WITH {_WITH_MEDIAN}
SELECT CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS point,
       CASE WHEN z > 0 THEN 'drift_up' ELSE 'drift_down' END AS drift, COUNT(*) AS days
FROM z GROUP BY 1, 2"""
)
def direction(spark, sf):
    return (
        _day_scores(spark, sf)
        .groupBy(
            F.expr(robust.direction("z", "spike", "drop")).alias("point"),
            F.expr(robust.direction("z", "drift_up", "drift_down")).alias("drift"),
        )
        .agg(F.count("*").alias("days"))
    )


_LEVELS = "(VALUES ('low', 3.0), ('medium', 2.5), ('high', 2.0), ('other', 2.5)) AS s(sensitivity, least)"


@query(
    f"""WITH {_WITH_MEDIAN}
SELECT sensitivity, COUNT(*) AS flagged FROM z, {_LEVELS} WHERE abs(z) >= least GROUP BY 1"""
)
def sensitivity_threshold(spark, sf):
    """Days flagged at each sensitivity; an unknown one counts as medium."""
    passed = [
        F.when(F.abs("z") >= checks.sensitivity_threshold(label), label)
        for label in (*SENSITIVITY, "other")
    ]
    flagged = _day_scores(spark, sf).select(F.explode(F.array_compact(F.array(*passed))).alias("sensitivity"))
    return flagged.groupBy("sensitivity").agg(F.count("*").alias("flagged"))


@query(
    f"""WITH {_WITH_MEDIAN}
SELECT label, COUNT(*) AS flagged
FROM z, (VALUES ('low', 3.5), ('low', 3.0), ('medium', 2.9), ('medium', 2.5), ('high', 2.4))
  AS t(label, least) WHERE abs(z) >= least GROUP BY 1"""
)
def threshold_to_label(spark, sf):
    """Days flagged at configured thresholds, under the label each stands for."""
    passed = [
        F.when(F.abs("z") >= least, checks.threshold_label(least))
        for least in (3.5, 3.0, 2.9, 2.5, 2.4)
    ]
    flagged = _day_scores(spark, sf).select(F.explode(F.array_compact(F.array(*passed))).alias("label"))
    return flagged.groupBy("label").agg(F.count("*").alias("flagged"))


@query(
    """SELECT 'usage_account_id+region' AS group_label,
       usage_account_id || ' / ' || CASE region WHEN '' THEN 'unknown' ELSE region END AS group_value,
       SUM(total_net_amortized_cost) AS cost
FROM summary GROUP BY usage_account_id, region"""
)
def group_label(spark, sf):
    keys = checks.group_columns("account+region")
    return (
        tables.summary_rows(spark, sf, keys)
        .groupBy(*keys)
        .agg(F.sum("total_net_amortized_cost").alias("cost"))
        .select(
            F.lit(labels.group_label(keys)).alias("group_label"),
            labels.group_value(keys).alias("group_value"),
            "cost",
        )
    )


@query(
    """SELECT COALESCE(NULLIF(region, ''), 'unknown') AS region, SUM(total_net_amortized_cost) AS cost
FROM summary GROUP BY 1"""
)
def unknown_label(spark, sf):
    return (
        tables.summary_rows(spark, sf, ["region"])
        .groupBy(labels.unknown_label(F.col("region")).alias("region"))
        .agg(F.sum("total_net_amortized_cost").alias("cost"))
    )


@query(f"WITH {_PERIOD_COSTS} SELECT group_value, format('${{:,.2f}}', b_cost) AS text FROM costs")
def money_text(spark, sf):
    return _period_costs(spark, sf).select(
        "group_value", amounts.money_text(F.col("b_cost")).alias("text")
    )


@query(
    f"""WITH {_PERIOD_COSTS}
SELECT group_value, CASE WHEN a_cost = 0 THEN '—'
       ELSE CASE WHEN b_cost > a_cost THEN '+' ELSE '' END
            || format('{{:.1f}}%', (b_cost - a_cost) / a_cost * 100) END AS text
FROM costs"""
)
def pct_text(spark, sf):
    change = amounts.pct_change(F.col("b_cost") - F.col("a_cost"), F.col("a_cost"))
    return _period_costs(spark, sf).select("group_value", amounts.pct_text(change).alias("text"))


@query(
    f"""WITH {_PERIOD_COSTS}
SELECT group_value,
       group_value || ' cost changed from ' || format('${{:,.2f}}', a_cost) || ' to '
       || format('${{:,.2f}}', b_cost) || ' (' || CASE WHEN b_cost >= a_cost THEN '+' ELSE '' END
       || format('${{:,.2f}}', b_cost - a_cost)
       || CASE WHEN a_cost = 0 THEN '' ELSE ', ' || CASE WHEN b_cost >= a_cost THEN '+' ELSE '' END
            || format('{{:.1f}}%', (b_cost - a_cost) / a_cost * 100) END || ').' AS summary
FROM costs"""
)
def summary_text(spark, sf):
    text = amounts.change_text(F.col("group_value"), F.col("a_cost"), F.col("b_cost"))
    return _period_costs(spark, sf).select("group_value", text.alias("summary"))


@query(
    """SELECT '{"usage_date":"' || usage_date || '","product_code":"' || product_code
       || '","line_items":' || COUNT(*) || ',"resource_id":null}' AS row
FROM line_items GROUP BY usage_date, product_code"""
)
def json_safe(spark, sf):
    rows = tables.line_items(spark, sf, ["usage_start_date", "product_code"])
    daily = rows.groupBy(
        dates.to_day(F.col("usage_start_date")).alias("usage_date"), "product_code"
    ).agg(F.count("*").alias("line_items"))
    return adhoc.json_rows(daily.withColumn("resource_id", F.lit(None).cast("string")))


@query(
    """SELECT CASE product_code WHEN 'purchase' THEN 'AmazonS3' WHEN 'signup' THEN 'awskms'
            ELSE product_code END AS product_code, SUM(cost) AS cost
FROM api_rows GROUP BY 1"""
)
def map_lookup(spark, sf):
    kind = F.col("product_code")
    name = (
        F.when(kind == "purchase", "Amazon Simple Storage Service")
        .when(kind == "signup", "AWS Key Management Service")
        .otherwise(kind)
    )
    return (
        tables.api_rows(spark, sf)
        .groupBy(labels.service_code(name).alias("product_code"))
        .agg(F.sum("total_net_amortized_cost").alias("cost"))
    )


@query(
    """SELECT usage_date, COUNT(*) AS groups, MIN(usage_account_id) AS first_account, SUM(cost) AS cost
FROM api_cells GROUP BY 1""",
    text=("usage_date",),
)
def nested_access(spark, sf):
    """Counts and sums taken from inside nested API pages without flattening them."""
    pages = api_pages(spark, sf).select(F.get("ResultsByTime", F.lit(0)).alias("r"))
    groups = F.col("r.Groups")
    return pages.select(
        F.col("r.TimePeriod.Start").cast("date").alias("usage_date"),
        F.size(groups).alias("groups"),
        F.array_min(F.transform(groups, lambda g: F.get(g["Keys"], F.lit(1)))).alias("first_account"),
        F.aggregate(
            groups,
            F.lit(0.0),
            lambda total, g: total + g["Metrics"]["NetAmortizedCost"]["Amount"].cast("double"),
        ).alias("cost"),
    )


@query(
    f"""SELECT group_value, kind, z_score,
       CASE WHEN kind = 'trend' THEN z_score * 100 END AS drift_pct
FROM ({anomalies_sql("product_code", str(WHOLE[0]), str(WHOLE[1]))})"""
)
def drift_pct(spark, sf):
    """The drift in percent beside each anomaly by product."""
    found = scanned(spark, sf)
    return anomalies.with_drift_pct(found).select("group_value", "kind", "z_score", "drift_pct")
