"""Scans, sources, sinks and incremental maintenance."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import SparkSession, functions as F

from ledgerloom.checks import month_period
from ledgerloom.functions.dates import billing_period, period_start, to_day
from ledgerloom.functions.labels import service_code
from ledgerloom.model import DAILY_SUMMARY, INGESTION_LOG, conform
from ledgerloom.operators import ingestion
from ledgerloom.operators import summary as summary_ops
from ledgerloom.plans import samples
from ledgerloom.plans.registry import query, scratch
from ledgerloom.sources import billing_files, day_index, distinct_sketches, manifests
from ledgerloom.sources import sample_tables as tables
from ledgerloom.sources import tables as storage
from ledgerloom.sources.api_pages import api_costs, drop_zero_costs

_FILE = "billing_period || '/' || line_item_type || '.parquet'"
_FILES = f"""files AS (
  SELECT billing_period, {_FILE} AS s3_key, 'assembly-' || lower(line_item_type) AS assembly_id,
         COUNT(*) AS rows_loaded, MAX(usage_start_date) AS last_usage
  FROM line_items GROUP BY billing_period, line_item_type)"""
_DISPLAY = """CASE product_code WHEN 'view' THEN 'AWSLambda' WHEN 'click' THEN 'AmazonCloudFront'
            ELSE product_code END"""


def _per_period(rows):
    return rows.groupBy("billing_period_start").agg(
        F.count("*").alias("line_items"), F.sum("net_unblended_cost").alias("cost")
    )


_PER_PERIOD = """SELECT CAST(billing_period_start AS VARCHAR) AS billing_period_start,
       COUNT(*) AS line_items, SUM(net_unblended_cost) AS cost
FROM line_items"""


@query(
    """SELECT CASE WHEN line_item_type = 'Refund' THEN 'v1' ELSE 'v2' END AS source_folder,
       CAST(billing_period_start AS VARCHAR) AS billing_period_start,
       COUNT(*) AS line_items, SUM(net_unblended_cost) AS cost, MIN(resource_id) AS first_resource
FROM line_items GROUP BY 1, 2"""
)
def cur_scan(spark, sf):
    """Exports of both generations written as files and read back in one scan."""
    root = scratch(spark)
    for generation, export in samples.exports(spark, sf).items():
        export.write.parquet(f"{root}/{generation}")
    keys = billing_files.list_files(spark, root).filter(F.col("key").endswith(".parquet"))
    rows = ingestion.read_exports(spark, keys.withColumnRenamed("key", "s3_key"), root)
    return rows.groupBy(
        F.split_part("_source_file", F.lit("/"), F.lit(1)).alias("source_folder"),
        "billing_period_start",
    ).agg(
        F.count("*").alias("line_items"),
        F.sum("net_unblended_cost").alias("cost"),
        F.min("resource_id").alias("first_resource"),
    )


@query(
    """SELECT CASE WHEN line_item_type = 'Refund' THEN 'v1' ELSE 'v2' END AS generation,
       COUNT(*) AS line_items FROM line_items GROUP BY 1"""
)
def cur_version_detect(spark, sf):
    v1, v2 = [
        export.groupBy(F.lit(billing_files.export_generation(export.columns)).alias("generation"))
        .agg(F.count("*").alias("line_items"))
        for export in samples.exports(spark, sf).values()
    ]
    return v1.unionByName(v2)


@query(
    """SELECT missing_column, COUNT(*) AS line_items
FROM line_items, (VALUES ('availability_zone'), ('line_item_description'), ('payer_account_id'),
  ('region')) AS missing(missing_column)
GROUP BY 1"""
)
def cur_validate(spark, sf):
    """Optional columns an export lacks, with the line items that get NULL there."""
    lacking = ["availability_zone", "line_item_description", "payer_account_id", "region"]
    found = []
    for generation, export in samples.exports(spark, sf).items():
        sources = billing_files.column_map(generation)
        export = export.drop(*[sources[c] for c in lacking])
        missing = billing_files.missing_optional(export.columns)
        found.append(export.select(F.explode(F.array(*[F.lit(c) for c in missing])).alias("missing_column")))
    return found[0].unionByName(found[1]).groupBy("missing_column").agg(F.count("*").alias("line_items"))


_NORMALIZED = """SELECT product_code, usage_type,
       CAST(billing_period_end AS VARCHAR) AS billing_period_end,
       COUNT(*) AS line_items, COUNT(resource_id) AS with_resource,
       CAST(SUM(length(line_item_id)) AS BIGINT) AS id_length,
       CAST(MAX(usage_end_date) AS VARCHAR) AS last_end,
       SUM(unblended_cost) AS unblended_cost, SUM(net_unblended_cost) AS net_unblended_cost,
       SUM(usage_amount) AS usage_amount
FROM line_items"""


def _normalized(rows):
    return rows.groupBy("product_code", "usage_type", "billing_period_end").agg(
        F.count("*").alias("line_items"),
        F.count("resource_id").alias("with_resource"),
        F.sum(F.length("line_item_id")).alias("id_length"),
        F.max("usage_end_date").alias("last_end"),
        F.sum("unblended_cost").alias("unblended_cost"),
        F.sum("net_unblended_cost").alias("net_unblended_cost"),
        F.sum("usage_amount").alias("usage_amount"),
    )


@query(f"{_NORMALIZED} GROUP BY ALL")
def cur_normalize(spark, sf):
    export = samples.as_export(tables.line_items(spark, sf), "v1")
    return _normalized(billing_files.normalize_export(export, "lineitem.parquet"))


@query(f"{_NORMALIZED} GROUP BY ALL")
def concat_files(spark, sf):
    """Files of both generations appended into one line-item table."""
    old, new = [
        billing_files.normalize_export(export, generation)
        for generation, export in samples.exports(spark, sf).items()
    ]
    return _normalized(old.unionByName(new))


@query("SELECT DISTINCT billing_period FROM line_items")
def period_discover(spark, sf):
    files = samples.export_files(spark, sf)
    return manifests.billing_periods(files.select(F.col("s3_key").alias("key")))


@query(
    f"""SELECT DISTINCT billing_period, billing_period || '/2-Manifest.json' AS manifest_key,
       'assembly-usage' AS assembly_id, {_FILE} AS s3_key
FROM line_items"""
)
def manifest_read(spark, sf):
    parsed = manifests.parse_manifests(
        manifests.latest_manifests(samples.manifest_files(spark, sf))
    )
    return parsed.select(
        "billing_period", "manifest_key", "assembly_id", F.explode("report_keys").alias("s3_key")
    )


@query("SELECT DISTINCT billing_period, billing_period AS manifest_period, true AS is_parquet FROM line_items")
def manifest_period(spark, sf):
    latest = manifests.latest_manifests(samples.manifest_files(spark, sf))
    return manifests.parse_manifests(latest).select(
        "billing_period", "manifest_period", "is_parquet"
    )


@query(
    f"""SELECT usage_date, usage_account_id, {_DISPLAY} AS product_code,
       cost AS total_unblended_cost, cost AS total_blended_cost, cost AS total_net_amortized_cost
FROM api_cells""",
    text=("usage_date",),
)
def api_cost_scan(spark, sf):
    return api_costs(samples.api_pages(spark, sf))


@query(
    """SELECT CASE event_type WHEN 'view' THEN 'AWSLambda' WHEN 'click' THEN 'AmazonCloudFront'
            ELSE event_type END AS product_code, COUNT(*) AS rows
FROM events GROUP BY 1"""
)
def api_service_map(spark, sf):
    kind = F.col("product_code")
    name = (
        F.when(kind == "view", "AWS Lambda").when(kind == "click", "Amazon CloudFront").otherwise(kind)
    )
    return (
        tables.api_rows(spark, sf)
        .groupBy(service_code(name).alias("product_code"))
        .agg(F.count("*").alias("rows"))
    )


@query(
    """SELECT product_code, COUNT(*) AS rows, SUM(cost / 256) AS cost
FROM api_rows WHERE NOT (cost / 256 < 0.001) GROUP BY product_code"""
)
def api_zero_filter(spark, sf):
    rows = tables.api_rows(spark, sf)
    small = rows.withColumns(
        {c: F.col(c) / 256 for c in rows.columns if c.startswith("total_")}
    )
    return (
        drop_zero_costs(small)
        .groupBy("product_code")
        .agg(F.count("*").alias("rows"), F.sum("total_net_amortized_cost").alias("cost"))
    )


@query("SELECT * FROM summary WHERE data_source = 'cost_explorer'", text=("usage_date",))
def api_pad(spark, sf):
    return summary_ops.api_summary(tables.api_cells(spark, sf))


@query("SELECT * FROM summary", text=("usage_date",))
def summary_scan(spark, sf):
    return tables.daily_summary(spark, sf)


@query(
    """SELECT line_item_id, usage_start_date, billing_period_start, usage_account_id, product_code,
       region, usage_type, operation, resource_id, line_item_type, net_unblended_cost, usage_amount
FROM line_items""",
    text=("usage_start_date", "billing_period_start"),
)
def lineitem_scan(spark, sf):
    return tables.line_items(
        spark,
        sf,
        ["line_item_id", "usage_start_date", "billing_period_start", "usage_account_id",
         "product_code", "region", "usage_type", "operation", "resource_id", "line_item_type",
         "net_unblended_cost", "usage_amount"],
    )


@query(f"{_PER_PERIOD} GROUP BY billing_period_start")
def lineitem_append(spark, sf):
    """Both exports appended to a stored table, which is then read back."""
    root = scratch(spark)
    for generation, export in samples.exports(spark, sf).items():
        storage.append_line_items(billing_files.normalize_export(export, generation), root)
    return _per_period(storage.read_line_items(spark, root))


@query(
    """SELECT product_code, COUNT(*) AS line_items, SUM(net_unblended_cost) AS cost FROM line_items
WHERE CAST(usage_start_date AS DATE) BETWEEN DATE '1997-03-10' AND DATE '1997-05-05' GROUP BY 1"""
)
def stored_day_range(spark, sf):
    """Eight weeks of stored line items, for which files of other days are not opened."""
    root = scratch(spark)
    for generation, export in samples.exports(spark, sf).items():
        storage.append_line_items(billing_files.normalize_export(export, generation), root)
    day_index.index_line_items(spark, root)
    rows = day_index.read_line_items_of(spark, root, [(date(1997, 3, 10), date(1997, 5, 5))])
    return rows.groupBy("product_code").agg(F.count("*").alias("line_items"), F.sum("net_unblended_cost").alias("cost"))


def _log(spark, sf):
    files = samples.export_files(spark, sf).withColumns(
        {"rows_loaded": F.col("rows"), "ingested_at": F.col("last_usage")}
    )
    return conform(files, INGESTION_LOG)


@query(
    f"""WITH {_FILES}
SELECT billing_period, assembly_id FROM (
  SELECT *, row_number() OVER (
    PARTITION BY billing_period ORDER BY last_usage DESC, assembly_id DESC) AS place FROM files)
WHERE place = 1"""
)
def assembly_latest(spark, sf):
    return ingestion.latest_assemblies(_log(spark, sf))


@query(
    f"""WITH {_FILES},
held AS (
  SELECT billing_period, arg_max(assembly_id, (last_usage, assembly_id)) AS held FROM files
  WHERE last_usage < TIMESTAMP '2000-01-01' GROUP BY billing_period)
SELECT billing_period, 'assembly-usage' AS assembly_id, s3_key,
       CASE WHEN held <> 'assembly-usage' THEN 'replace'
            WHEN held = 'assembly-usage' AND assembly_id = 'assembly-usage' THEN 'skip'
            ELSE 'load' END AS action
FROM files LEFT JOIN held USING (billing_period)"""
)
def ingest_plan(spark, sf):
    """Manifest files against a log that knows the periods before 2000."""
    parsed = manifests.parse_manifests(
        manifests.latest_manifests(samples.manifest_files(spark, sf))
    )
    log = _log(spark, sf).filter(F.col("ingested_at") < F.lit("2000-01-01").cast("timestamp_ntz"))
    return ingestion.ingest_plan(manifests.report_keys(parsed), log)


@query(
    """SELECT billing_period, strftime(billing_period_start, '%Y-%m') AS month, COUNT(*) AS line_items
FROM line_items GROUP BY ALL"""
)
def month_to_period(spark, sf):
    """Months as billing periods; a single month goes by the same rule."""
    day = to_day(F.col("usage_start_date"))
    rows = tables.line_items(spark, sf, ["usage_start_date"])
    assert month_period("1997-12") == "19971201-19980101"
    return rows.groupBy(
        billing_period(day).alias("billing_period"), F.date_format(day, "yyyy-MM").alias("month")
    ).agg(F.count("*").alias("line_items"))


@query(f"{_PER_PERIOD} WHERE billing_period <> '19970301-19970401' GROUP BY billing_period_start")
def period_delete(spark, sf):
    rows = tables.line_items(spark, sf, ["billing_period_start", "net_unblended_cost"])
    return _per_period(ingestion.delete_period(rows, month_period(samples.MONTH)))


@query(
    f"WITH {_FILES} SELECT billing_period, assembly_id, s3_key, rows_loaded FROM files"
)
def ingest_log_append(spark, sf):
    """Log entries of all files, appended to a stored log and read back."""
    files = samples.export_files(spark, sf)
    rows = tables.line_items(spark, sf, ["usage_start_date", "line_item_type"])
    period = billing_period(to_day(F.col("usage_start_date")))
    key = F.concat(period, F.lit("/"), F.col("line_item_type"), F.lit(".parquet"))
    root = scratch(spark)
    entries = ingestion.log_entries(rows.select(key.alias("_source_file")), files)
    storage.append_log(entries, root)
    return storage.read_log(spark, root).drop("ingested_at")


@query(
    f"""SELECT billing_period, {_FILE} AS s3_key, 'loaded' AS outcome FROM line_items
WHERE billing_period_start < DATE '2001-01-01' GROUP BY ALL
UNION ALL
SELECT DISTINCT billing_period, NULL,
       CASE WHEN billing_period_start < DATE '2001-05-01' THEN 'no reportKeys'
            WHEN billing_period_start < DATE '2001-09-01' THEN 'no assemblyId'
            ELSE 'invalid JSON' END
FROM line_items WHERE billing_period_start >= DATE '2001-01-01'"""
)
def ingest_error_isolation(spark, sf):
    """Manifests of 2001 are broken in three ways; the others still load."""
    start = period_start(F.col("billing_period"))
    content = F.col("content")
    latest = manifests.latest_manifests(samples.manifest_files(spark, sf))
    broken = latest.withColumn(
        "content",
        F.when(start < F.lit(date(2001, 1, 1)), content)
        .when(
            start < F.lit(date(2001, 5, 1)),
            F.regexp_replace(content, r'"reportKeys":\[.*?\]', '"reportKeys":[]'),
        )
        .when(start < F.lit(date(2001, 9, 1)), F.replace(content, F.lit("assemblyId"), F.lit("id")))
        .otherwise(F.substring(content, 1, 20)),
    )
    parsed = manifests.parse_manifests(broken)
    loaded = manifests.report_keys(parsed).select(
        "billing_period", "s3_key", F.lit("loaded").alias("outcome")
    )
    rejected = manifests.rejected_manifests(parsed).select(
        "billing_period", F.lit(None).cast("string").alias("s3_key"), F.col("error").alias("outcome")
    )
    return loaded.unionByName(rejected)


_UNREADABLE, _LACKING = "19990501-19990601", "19990601-19990701"


def write_manifests(spark: SparkSession, root: str, assembly: str, names: list[str]) -> None:
    """One manifest per billing period that lists its files below the folders ``names``; the calendar bounds their number."""
    keys = billing_files.list_files(spark, root).select(
        "key",
        F.regexp_extract("key", r"/period=([^/]+)/[^/]+[.]parquet$", 1).alias("period"),
        F.split_part("key", F.lit("/"), F.lit(1)).alias("name"),
    )
    by_period = keys.filter((F.col("period") != "") & F.col("name").isin(names)).groupBy("period")
    for row in by_period.agg(F.sort_array(F.collect_list("key")).alias("keys")).collect():
        content = json.dumps({"assemblyId": assembly, "compression": "Parquet", "reportKeys": row["keys"]})
        samples.write_text(spark, f"{root}/{row['period']}/{assembly}-Manifest.json", content)


@query(
    f"""WITH stored AS (
  SELECT *, year(usage_start_date) = 2000 AS restated,
         CASE WHEN year(usage_start_date) = 2000 THEN unblended_cost * 2 ELSE unblended_cost END AS cost
  FROM line_items
  WHERE line_item_type <> 'Refund'
     OR year(usage_start_date) <> 2000 AND billing_period NOT IN ('{_UNREADABLE}', '{_LACKING}'))
SELECT 'line items' AS kind, billing_period, '' AS name, COUNT(*) AS rows, SUM(cost) AS cost
FROM stored GROUP BY billing_period
UNION ALL
SELECT 'summary', billing_period, product_code, COUNT(*), SUM(cost)
FROM stored WHERE line_item_type <> 'Refund' GROUP BY billing_period, product_code
UNION ALL
SELECT 'log', billing_period, CASE WHEN restated THEN 'second' ELSE 'first' END, COUNT(*), NULL
FROM stored GROUP BY billing_period, restated
UNION ALL
SELECT DISTINCT 'reject', billing_period,
       CASE billing_period WHEN '{_LACKING}' THEN 'unblended_cost' ELSE 'unreadable' END, 0, NULL
FROM line_items WHERE line_item_type = 'Refund' AND billing_period IN ('{_UNREADABLE}', '{_LACKING}')"""
)
def ingest_exports(spark, sf):
    """Export files of all periods ingested, some of them bad, and a year restated at twice its cost.

    Refunds come in files of the older generation; those of one period are unreadable, those of another
    have no cost. The second assembly of 2000 has no refunds.
    """
    root, store = scratch(spark), scratch(spark)
    rows = tables.line_items(spark, sf)
    period, refund = billing_period(to_day(F.col("usage_start_date"))), F.col("line_item_type") == "Refund"
    samples.write_export(rows.filter(~refund), "v2", root, "usage")
    samples.write_export(rows.filter(refund & (period != _LACKING)), "v1", root, "refunds")
    samples.write_export(rows.filter(refund & (period == _LACKING)), "v1", root, "lacking", "unblended_cost")
    unreadable = F.col("key").startswith(f"refunds/period={_UNREADABLE}/") & F.col("key").endswith(".parquet")
    for row in billing_files.list_files(spark, root).filter(unreadable).collect():
        samples.write_text(spark, f"{root}/{row['key']}", "no Parquet")
    write_manifests(spark, root, "first", ["usage", "refunds", "lacking"])
    ingestion.ingest_exports(spark, root, store)
    year = F.year("usage_start_date") == 2000
    twice = rows.filter(~refund & year).withColumn("unblended_cost", F.col("unblended_cost") * 2)
    samples.write_export(twice, "v2", root, "restated")
    write_manifests(spark, root, "second", ["restated"])
    ingestion.ingest_exports(spark, root, store)

    cost = F.sum("unblended_cost").alias("cost")
    stored = storage.read_line_items(spark, store)
    summary = storage.read_summary(spark, store)
    log = storage.read_log(spark, store)
    reason = F.when(F.col("error").contains("unblended_cost"), "unblended_cost").otherwise("unreadable")
    none = F.lit(None).cast("double").alias("cost")
    found = [
        stored.groupBy(F.lit("line items").alias("kind"), period.alias("billing_period"), F.lit("").alias("name"))
        .agg(F.count("*").alias("rows"), cost),
        summary.groupBy(F.lit("summary").alias("kind"), billing_period(F.col("usage_date")).alias("billing_period"), F.col("product_code").alias("name"))
        .agg(F.sum("line_item_count").alias("rows"), F.sum("total_unblended_cost").alias("cost")),
        log.groupBy(F.lit("log").alias("kind"), "billing_period", F.col("assembly_id").alias("name"))
        .agg(F.sum("rows_loaded").alias("rows"), none),
        storage.read_rejects(spark, store)
        .select(F.lit("reject").alias("kind"), "billing_period", reason.alias("name")).distinct()
        .select("*", F.lit(0).cast("long").alias("rows"), none),
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(
    """SELECT usage_date, usage_account_id, product_code, data_source,
       total_net_amortized_cost AS cost
FROM summary
WHERE NOT (data_source = 'cost_explorer'
       AND usage_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20')
UNION ALL
SELECT usage_date, usage_account_id, product_code, 'cost_explorer', cost * 2
FROM api_cells
WHERE product_code = 'purchase' AND usage_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""",
    text=("usage_date",),
)
def summary_upsert_range(spark, sf):
    """Stored API costs, then the purchases of ten days restated at twice their cost."""
    restated = tables.api_cells(spark, sf).filter(
        (F.col("product_code") == "purchase")
        & F.col("usage_date").between(date(2024, 1, 10), date(2024, 1, 20))
    )
    restated = restated.withColumns(
        {c: F.col(c) * 2 for c in restated.columns if c.startswith("total_")}
    )
    root = scratch(spark)
    for incoming in (tables.api_cells(spark, sf), restated):
        storage.write_summary_range(summary_ops.api_summary(incoming), root)
    exported = summary_ops.summarize_line_items(tables.line_items(spark, sf))
    return summary_ops.union_sources(exported, storage.read_summary(spark, root)).select(
        "usage_date",
        "usage_account_id",
        "product_code",
        "data_source",
        F.col("total_net_amortized_cost").alias("cost"),
    )


@query(
    """SELECT column_name, CAST(n AS BIGINT) AS n, true AS within FROM (
  SELECT COUNT(DISTINCT usage_account_id) AS usage_account_id, COUNT(DISTINCT product_code) AS product_code,
         COUNT(DISTINCT region) AS region FROM export_summary
  WHERE usage_date BETWEEN DATE '1996-02-10' AND DATE '1997-11-20')
UNPIVOT (n FOR column_name IN (usage_account_id, product_code, region))"""
)
def agg_sketched_distinct(spark, sf):
    """Exact distinct counts of a range of a stored summary, and whether the merged sketches of its days come near."""
    root, first, last = scratch(spark), date(1996, 2, 10), date(1997, 11, 20)
    storage.write_rebuilt_summary(summary_ops.summarize_line_items(tables.line_items(spark, sf)), root)
    distinct_sketches.store_sketches(spark, root)
    names = distinct_sketches.COUNTED
    exact = storage.read_summary(spark, root, first, last).agg(*[F.countDistinct(c).alias(names[c]) for c in names])
    counts = exact.withColumn("exact", F.lit(True)).unionByName(
        distinct_sketches.distinct_counts(spark, root, first, last).withColumn("exact", F.lit(False))
    )
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(names[c]).alias("count")) for c in names]
    n = F.max(F.when(F.col("exact"), F.col("count")))
    off = F.abs(n - F.max(F.when(~F.col("exact"), F.col("count"))))
    return counts.select("exact", F.inline(F.array(*cells))).groupBy("column_name").agg(
        n.alias("n"), (off <= distinct_sketches.ERROR * n).alias("within")
    )


@query(
    """SELECT product_code, 'cur' AS data_source, SUM(total_unblended_cost) AS unblended,
       CAST(0.0 AS DOUBLE) AS net, COUNT(*) AS rows
FROM export_summary GROUP BY product_code"""
)
def schema_migrate(spark, sf):
    """A summary written before the source and the net cost existed."""
    older = summary_ops.summarize_line_items(tables.line_items(spark, sf)).drop(
        "data_source", "total_net_amortized_cost"
    )
    return (
        conform(older, DAILY_SUMMARY)
        .groupBy("product_code", "data_source")
        .agg(
            F.sum("total_unblended_cost").alias("unblended"),
            F.sum("total_net_amortized_cost").alias("net"),
            F.count("*").alias("rows"),
        )
    )


@query(
    """SELECT 'line_items' AS name, (SELECT COUNT(*) FROM line_items) > 0 AS has_rows
UNION ALL SELECT 'summary', (SELECT COUNT(*) FROM summary) > 0
UNION ALL SELECT 'future', (SELECT COUNT(*) FROM summary WHERE usage_date > DATE '2030-01-01') > 0"""
)
def table_emptiness(spark, sf):
    """Whether a table has any row, as rows; `require_rows` asks the same at once."""
    summary = tables.summary_rows(spark, sf, [])
    named = {
        "line_items": tables.line_items(spark, sf, ["net_unblended_cost"]),
        "summary": summary,
        "future": summary.filter(F.col("usage_date") > F.lit(date(2030, 1, 1))),
    }
    answers = [
        df.limit(1).agg((F.count("*") > 0).alias("has_rows")).select(F.lit(name).alias("name"), "has_rows")
        for name, df in named.items()
    ]
    return answers[0].unionByName(answers[1]).unionByName(answers[2])


@query(
    """SELECT CAST(billing_period_start AS VARCHAR) AS billing_period_start, COUNT(*) AS line_items,
       SUM(CASE WHEN billing_period_start >= DATE '2000-01-01' THEN unblended_cost * 2
                ELSE unblended_cost END) AS cost
FROM line_items
WHERE billing_period_start < DATE '2000-01-01' OR line_item_type <> 'Refund'
GROUP BY billing_period_start"""
)
def overlay_versions(spark, sf):
    """Periods from 2000 on replaced by an assembly without refunds at twice the cost."""
    rows = tables.line_items(
        spark, sf, ["billing_period_start", "line_item_type", "unblended_cost"]
    )
    newer = rows.filter(
        (F.col("billing_period_start") >= F.lit(date(2000, 1, 1)))
        & (F.col("line_item_type") != "Refund")
    ).withColumn("unblended_cost", F.col("unblended_cost") * 2)
    return (
        ingestion.replace_periods(rows, newer)
        .groupBy("billing_period_start")
        .agg(F.count("*").alias("line_items"), F.sum("unblended_cost").alias("cost"))
    )
