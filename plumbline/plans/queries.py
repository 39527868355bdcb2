"""The registered queries: every operator over whole given tables.

Queries that need an order or several passes read a table that was numbered and stored first, as
an ingested dataset is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.names import identifier_expr, resolve_roles, role_table
from plumbline.functions import scalars
from plumbline.functions.scalars import cancellation_marker, iso_text, parse_date, text_number
from plumbline.operators import anomaly, distribution, explain, forest, profile, quality
from plumbline.operators import faults, uniqueness as copies
from plumbline.plans import ledger, report
from plumbline.plans.retail import stored_lines, stored_retail, table
from plumbline.sources import catalog as cat, readers
from plumbline.sources.rows import ROW_NUMBER, data_columns, stored_by
from plumbline.sources.storage import new_path, pin, store_once

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# The tables whose headers the header queries look at.
HEADER_TABLES = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem",
                 "nation", "orders", "pages", "part", "region", "supplier"]
CSV_TABLES = ["customer", "orders", "part", "supplier"]
SEARCH_TEXT = "SRC1"
EXPLAINED_ROW = 17
PAGE_OFFSET, PAGE_LIMIT = 20, 20


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def rounded(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# --- sources and catalog -----------------------------------------------------------

def _as_csv(df: DataFrame, label: str) -> str:
    path = f"{new_path(df.sparkSession, 'csv')}/{label}.csv"
    df.write.csv(path, header=True)
    return path


@query
def scan_typed_csv(spark, sf):
    return readers.read_typed_csv(spark, _as_csv(table(spark, sf, "customer"), "customer"))


@query
def scan_spanning_csv(spark, sf):
    """Documents as delimited text: their quoted fields span lines and hold quotes and commas."""
    path = f"{new_path(spark, 'csv')}/documents.csv"
    exact = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table(spark, sf, "documents").write.options(**exact).csv(path)
    return readers.read_typed_csv(spark, path)


@query
def ingest_summary(spark, sf):
    """Four files, then the first again, an empty one and one with another extension."""
    kept = [
        readers.ingest_csv(spark, _as_csv(table(spark, sf, name), name), new_path(spark, f"ingested-{name}"))
        .withColumn("id", F.lit(i).cast("bigint"))
        for i, name in enumerate(CSV_TABLES, 1)
    ]
    known = pin(cat.union_metadata(kept))
    again = table(spark, sf, CSV_TABLES[0])
    others = [
        _as_csv(again.repartition(3), "again"),
        _as_csv(table(spark, sf, "orders").filter(F.col("o_totalprice") < 0), "negative_orders"),
        _as_csv(again, "named").removesuffix(".csv") + ".txt",
    ]
    answers = [readers.ingest_csv(spark, path, new_path(spark, "ingested"), known) for path in others]
    return cat.union_metadata([known.drop("id"), *answers]).select(
        "file_name", "rows_count", "columns_count", "status", "reason", "dataset_id"
    )


def document_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a stored dataset; the folder layout depends on its language."""
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".csv"))
    folder = F.concat(F.lit("uploads/"), F.col("source"), F.lit("/"))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    commas = F.length("text") - F.length(F.replace("text", F.lit(","), F.lit(""))) + 1
    records = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.col("source"), F.lit(" "), F.col("lang"), F.lit(" "), name).alias("file_name"),
        F.when(F.col("lang") == "fr", F.concat(folder, F.lit("../"), name))
        .when(F.col("lang") == "de", F.concat(folder, F.lit("../../outside/"), name))
        .when(F.col("lang") == "es", F.concat(F.lit("uploads/./"), F.col("source"), F.lit("//"), name))
        .otherwise(F.concat(folder, name)).alias("file_path"),
        lines.cast("bigint").alias("rows_count"),
        commas.cast("bigint").alias("columns_count"),
        "text",
    )
    return cat.with_fingerprint(records, "text")


@query
def content_fingerprint(spark, sf):
    return document_catalog(spark, sf).select("id", "content_length", "content_sha")


@query
def table_fingerprint(spark, sf):
    return cat.table_fingerprint(table(spark, sf, "orders"))


@query
def catalog_valid_paths(spark, sf):
    return cat.valid_paths(document_catalog(spark, sf)).select("id", "file_path", "resolved_path")


@query
def catalog_latest_distinct(spark, sf):
    return cat.latest_distinct(cat.valid_paths(document_catalog(spark, sf))).select(
        "id", "file_name", "content_length"
    )


@query
def catalog_find_duplicate(spark, sf):
    uploads = document_catalog(spark, sf).withColumnRenamed("id", "upload_id")
    return cat.find_duplicates(uploads, cat.valid_paths(document_catalog(spark, sf)))


def _most_copied(records: DataFrame) -> int:
    top = records.groupBy(*cat.CONTENT).agg(F.count("*").alias("copies"), F.max("id").alias("id"))
    return top.orderBy(F.col("copies").desc(), "content_sha").first()["id"]


@query
def catalog_remove_group(spark, sf):
    records = document_catalog(spark, sf)
    return cat.remove_group(records, _most_copied(records)).select("id", "status")


@query
def catalog_removal_counts(spark, sf):
    records = document_catalog(spark, sf)
    return cat.removal_counts(cat.remove_group(records, _most_copied(records)))


@query
def catalog_upsert(spark, sf):
    def path(key):
        return F.concat(F.lit("uploads/doc"), key.cast("string"), F.lit(".csv")).alias("file_path")

    known = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("file_name"), path(F.col("doc_id") + 700),
        F.col("n_chars").alias("rows_count"), F.lit(5).cast("bigint").alias("columns_count"),
    )
    sources = table(spark, sf, "customer").select(
        path(F.col("c_custkey")), F.col("c_nationkey").cast("bigint").alias("rows_count"),
        F.lit(8).cast("bigint").alias("columns_count"),
    )
    names = table(spark, sf, "supplier").select(path(F.col("s_suppkey")), F.col("s_name").alias("display_name"))
    return cat.refresh(known, sources, names)


@query
def catalog_search(spark, sf):
    positions = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), (F.col("quality") * 1_000_000 + F.col("doc_id")).cast("bigint").alias("position")
    )
    return cat.search(document_catalog(spark, sf), SEARCH_TEXT, positions).select("id", "file_name", "position")


@query
def inject_faults(spark, sf):
    faulty = faults.inject_faults(stored_lines(spark, sf), "l_returnflag", "l_extendedprice", "l_quantity")
    return faulty.select(ROW_NUMBER, "l_orderkey", "l_partkey", "l_returnflag", "l_extendedprice", "l_quantity")


# --- headers and roles -------------------------------------------------------------

def header_frame(spark: SparkSession, sf: str) -> DataFrame:
    """(table, ordinal, column, type, rows, missing) of several tables, from their data."""
    parts = [
        profile.column_missing(table(spark, sf, name)).withColumn("table_name", F.lit(name))
        for name in HEADER_TABLES
    ]
    parts.append(
        profile.column_missing(stored_retail(spark, sf)).withColumn("table_name", F.lit("retail"))
    )
    return reduce(DataFrame.unionByName, parts)


@query
def identifier_columns(spark, sf):
    return header_frame(spark, sf).select(
        "table_name", "column_name", "rows_count", identifier_expr(F.col("column_name")).alias("is_identifier")
    )


@query
def schema_roles(spark, sf):
    filled = header_frame(spark, sf).filter(F.col("missing_count") < F.col("rows_count"))
    return role_table(filled).select(
        "table_name", "role", "status", F.array_join("columns", ", ").alias("columns")
    )


@query
def numeric_fields(spark, sf):
    usable = F.col("data_type").isin("int", "bigint", "double") & ~identifier_expr(F.col("column_name"))
    return header_frame(spark, sf).filter(usable).select(
        "table_name", "column_name", (F.col("rows_count") - F.col("missing_count")).alias("value_count")
    )


@query
def logical_types(spark, sf):
    df = stored_retail(spark, sf)
    return profile.logical_type_table(profile.logical_types(df), df)


def stored_order_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their date written as text in several shapes, numbered by order key."""
    day = F.col("o_orderdate")
    texts = table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format(day, "yyyy-MM-dd").alias("iso_day"),
        F.date_format(day, "M/d/yyyy H:mm").alias("us_minute"),
        F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.date_format(day, "yyyy/MM/dd")).alias("partly"),
        F.col("o_orderpriority"),
    )
    return store_once(spark, f"dates{sf}", lambda: stored_by(texts, ["o_orderkey"], "dates"))


@query
def date_parse_ratio(spark, sf):
    return profile.date_parse_ratio(stored_order_dates(spark, sf))


@query
def parse_dates_mixed(spark, sf):
    day, priority = F.col("o_orderdate"), F.left("o_orderpriority", F.lit(1))
    mixed = (
        F.when(priority == "1", F.date_format(day, "yyyy-MM-dd"))
        .when(priority == "2", F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .when(priority == "3", F.date_format(day, "M/d/yyyy"))
        .when(priority == "4", F.date_format(day, "dd-MM-yyyy HH:mm"))
        .otherwise(F.concat(F.lit("week of "), F.date_format(day, "yyyy")))
    )
    return table(spark, sf, "orders").select("o_orderkey", iso_text(parse_date(mixed)).alias("parsed"))


# --- scalars -----------------------------------------------------------------------

@query
def to_numeric_lenient(spark, sf):
    return stored_retail(spark, sf).select(
        ROW_NUMBER, text_number(F.col("Quantity")).alias("quantity"),
        text_number(F.col("InvoiceNo")).alias("invoice"), text_number(F.col("Description")).alias("description"),
    )


@query
def cancellation_flag(spark, sf):
    return stored_retail(spark, sf).select(ROW_NUMBER, cancellation_marker(F.col("InvoiceNo")).alias("cancelled"))


@query
def report_text(spark, sf):
    """Whole texts made safe, and the same cut to a report cell."""
    return table(spark, sf, "documents").select(
        "doc_id", scalars.report_text(F.col("text")).alias("safe_text"),
        scalars.report_text(F.col("text"), 320).alias("cell_text"),
    )


@query
def report_names(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", scalars.report_name(F.concat("url", F.lit(".CSV"))).alias("download_name")
    )


# --- profile -----------------------------------------------------------------------

@query
def profile_summary(spark, sf):
    return profile.profile_summary(stored_retail(spark, sf))


@query
def column_missing(spark, sf):
    return profile.column_missing(stored_retail(spark, sf)).drop("data_type")


@query
def column_unique(spark, sf):
    return profile.column_unique(stored_retail(spark, sf))


@query
def column_samples(spark, sf):
    return profile.column_samples(stored_retail(spark, sf))


@query
def numeric_summary(spark, sf):
    df = table(spark, sf, "lineitem")
    return rounded(
        profile.numeric_summary(df, anomaly.numeric_fields(df)),
        "mean", "std", "minimum", "q25", "q50", "q75", "maximum",
    )


@query
def date_range(spark, sf):
    return profile.date_range(stored_order_dates(spark, sf), ["iso_day", "us_minute", "partly"])


@query
def top_values(spark, sf):
    df = stored_retail(spark, sf)
    return profile.top_values(df, [n for n, kind in profile.logical_types(df).items() if kind == "categorical"])


@query
def column_profile(spark, sf):
    return profile.column_profile(stored_retail(spark, sf))


# --- quality -----------------------------------------------------------------------

def _assessment(spark: SparkSession, sf: str) -> quality.Assessment:
    return quality.assess(stored_retail(spark, sf))


@query
def completeness(spark, sf):
    return quality.completeness(_assessment(spark, sf))


@query
def uniqueness(spark, sf):
    return quality.uniqueness(_assessment(spark, sf))


@query
def duplicate_rows(spark, sf):
    return copies.duplicate_rows(stored_retail(spark, sf)).select(ROW_NUMBER, "InvoiceNo", "StockCode")


@query
def validity(spark, sf):
    return quality.validity(_assessment(spark, sf))


@query
def invalid_rows(spark, sf):
    return quality.invalid_rows(stored_retail(spark, sf)).select(
        ROW_NUMBER, "InvoiceNo", "Quantity", "UnitPrice", "rules_broken"
    )


@query
def product_description(spark, sf):
    df = stored_retail(spark, sf)
    return quality.product_descriptions(df, resolve_roles(df.columns))


@query
def line_total(spark, sf):
    checks = quality.consistency_checks(_assessment(spark, sf))
    return checks.filter(F.col("rule") == "line_total")


@query
def line_total_mismatches(spark, sf):
    return quality.line_total_mismatches(stored_retail(spark, sf))


@query
def consistency(spark, sf):
    return quality.consistency(_assessment(spark, sf))


@query
def overall_quality(spark, sf):
    return quality.overall_quality(_assessment(spark, sf))


@query
def quality_dimensions(spark, sf):
    return quality.quality_dimensions(_assessment(spark, sf))


@query
def quality_empty(spark, sf):
    return quality.quality_dimensions(
        quality.assess(table(spark, sf, "orders").filter(F.col("o_totalprice") < 0))
    )


@query
def quality_issues(spark, sf):
    return quality.quality_issues(_assessment(spark, sf))


@query
def quality_issues_ranked(spark, sf):
    return quality.ranked_issues(quality.quality_issues(_assessment(spark, sf)))


# --- anomalies ---------------------------------------------------------------------

_reviews: dict[tuple[str, str], anomaly.Review] = {}


def retail_review(spark: SparkSession, sf: str) -> anomaly.Review:
    """All three methods over the retail table. Its parts are stored tables, so one review an
    application serves all queries."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _reviews:
        _reviews[key] = anomaly.review(stored_retail(spark, sf))
    return _reviews[key]


def stored_events(spark: SparkSession, sf: str) -> DataFrame:
    return store_once(
        spark, f"events{sf}", lambda: stored_by(table(spark, sf, "events"), ["event_id"], "events")
    )


@query
def anomaly_bounds(spark, sf):
    df = stored_retail(spark, sf)
    stats = anomaly.field_stats(df, anomaly.numeric_fields(df))
    return rounded(anomaly.bounds_table(df, anomaly.anomaly_bounds(df, stats)), "lower_bound", "upper_bound")


@query
def anomaly_method_counts(spark, sf):
    return anomaly.method_counts(retail_review(spark, sf))


@query
def anomaly_event_counts(spark, sf):
    return anomaly.method_counts(anomaly.review(stored_events(spark, sf)))


@query
def anomaly_method_status(spark, sf):
    return anomaly.method_status(anomaly.method_counts(retail_review(spark, sf)))


@query
def anomaly_summary(spark, sf):
    return anomaly.anomaly_summary(retail_review(spark, sf))


def _gate(df: DataFrame) -> forest.ForestGate:
    stats = anomaly.field_stats(df, anomaly.numeric_fields(df))
    return forest.forest_gate(df, {f: (s.rows, s.varies) for f, s in stats.items()})


@query
def forest_gate(spark, sf):
    gate = _gate(stored_retail(spark, sf))
    return spark.createDataFrame(
        [(", ".join(gate.fields), gate.complete_rows, gate.open)],
        "fields string, complete_rows bigint, is_open boolean",
    )


@query
def forest_sample(spark, sf):
    df = stored_retail(spark, sf)
    return forest.forest_sample(df, _gate(df)).select(ROW_NUMBER, "rank")


@query
def forest_model(spark, sf):
    df = stored_retail(spark, sf)
    return rounded(forest.forest_model(forest.forest_sample(df, _gate(df))), "threshold", "path", places=6)


@query
def forest_scores(spark, sf):
    return retail_review(spark, sf).scored.select(ROW_NUMBER, "forest_score")


@query
def forest_method_counts(spark, sf):
    return anomaly.method_counts(retail_review(spark, sf)).filter(F.col("method") == anomaly.FOREST)


@query
def forest_queue_page(spark, sf):
    return anomaly.anomaly_page(retail_review(spark, sf)).select(ROW_NUMBER, "votes", "forest_score")


def _signals(df: DataFrame) -> DataFrame:
    return df.select(ROW_NUMBER, "votes", F.array_join("signals", ", ").alias("signals"))


@query
def anomaly_votes(spark, sf):
    return _signals(retail_review(spark, sf).scored)


@query
def anomaly_queue(spark, sf):
    return _signals(anomaly.anomaly_queue(retail_review(spark, sf)))


@query
def anomaly_page(spark, sf):
    page = anomaly.anomaly_page(retail_review(spark, sf), PAGE_OFFSET, PAGE_LIMIT)
    return page.select(ROW_NUMBER, "votes", "next_offset")


@query
def anomaly_retail_context(spark, sf):
    return anomaly.retail_context(retail_review(spark, sf))


@query
def anomaly_evidence(spark, sf):
    return rounded(
        explain.anomaly_evidence(retail_review(spark, sf)), "boundary", "distance_from_boundary"
    )


@query
def row_interpretation(spark, sf):
    return explain.row_interpretation(retail_review(spark, sf))


def _flat_explanation(df: DataFrame) -> DataFrame:
    return df.select(
        ROW_NUMBER, "status", "votes", F.array_join("signals", ", ").alias("signals"), "invoice_number",
        "forest_score",
        *[F.col("values")[f].alias(f) for f in ("UnitPrice", "SuppKey", "OrderKey", "PartKey", "LineTotal")],
        F.array_join(F.transform("evidence", lambda e: e["message"]), "; ").alias("evidence"),
        "interpretation.category", "interpretation.business_rule", "interpretation.next_step",
        "business_context",
    )


@query
def row_explanation(spark, sf):
    """Every row explained; one row is the same frame filtered by its number."""
    return _flat_explanation(explain.explain_rows(retail_review(spark, sf)))


@query
def row_lookup(spark, sf):
    return _flat_explanation(explain.explain_row(retail_review(spark, sf), EXPLAINED_ROW))


# --- distributions -----------------------------------------------------------------

@query
def numeric_usability(spark, sf):
    df = stored_retail(spark, sf)
    numbers = [n for n in data_columns(df) if isinstance(df.schema[n].dataType, T.NumericType)]
    return distribution.numeric_usability(df, numbers)


@query
def discrete_counts(spark, sf):
    return distribution.discrete_counts(table(spark, sf, "lineitem"), "l_discount")


@query
def histogram_full(spark, sf):
    return rounded(
        distribution.full_histogram(table(spark, sf, "lineitem"), "l_extendedprice"), "lower_edge", "upper_edge"
    )


@query
def histogram_events(spark, sf):
    return rounded(distribution.full_histogram(table(spark, sf, "events"), "value"), "lower_edge", "upper_edge", places=6)


@query
def histogram_constant(spark, sf):
    """Recorded minus actual length of every document: zero everywhere, so a single bin."""
    gaps = table(spark, sf, "documents").select((F.col("n_chars") - F.length("text")).alias("length_gap"))
    return distribution.full_histogram(gaps, "length_gap")


@query
def histogram_central(spark, sf):
    return rounded(
        distribution.central_histogram(table(spark, sf, "events"), "value"), "lower_edge", "upper_edge", places=6
    )


@query
def time_buckets(spark, sf):
    return distribution.time_buckets(table(spark, sf, "lineitem"), "l_shipdate")


@query
def time_buckets_text(spark, sf):
    return distribution.time_buckets(stored_order_dates(spark, sf), "partly")


@query
def time_buckets_month(spark, sf):
    return distribution.time_buckets(table(spark, sf, "events"), "ts")


@query
def category_top_other(spark, sf):
    return distribution.category_top_other(table(spark, sf, "part"), "p_brand")


@query
def category_share(spark, sf):
    return distribution.category_share(table(spark, sf, "orders"), "o_orderpriority")


@query
def distribution_status(spark, sf):
    df = stored_retail(spark, sf)
    return distribution.distribution_status(df, profile.logical_types(df))


@query
def missing_ranking(spark, sf):
    return distribution.missing_ranking(profile.column_missing(stored_retail(spark, sf)))


@query
def signal_ranking(spark, sf):
    return distribution.signal_ranking(anomaly.method_counts(retail_review(spark, sf)))


for _ledger_query in ledger.QUERIES:
    query(_ledger_query)


# --- report ------------------------------------------------------------------------

@query
def report_headline(spark, sf):
    return report.report_headline(_assessment(spark, sf).pinned(), retail_review(spark, sf))


@query
def report_dimensions(spark, sf):
    return report.report_dimensions(_assessment(spark, sf))


@query
def report_findings(spark, sf):
    return report.report_findings(_assessment(spark, sf))


@query
def report_columns(spark, sf):
    return report.report_columns(profile.column_profile(stored_retail(spark, sf)))


@query
def report_methods(spark, sf):
    return report.report_methods(anomaly.method_counts(retail_review(spark, sf)))


@query
def report_notes(spark, sf):
    return report.report_notes(_assessment(spark, sf).pinned())


@query
def report_examples(spark, sf):
    return report.report_examples(retail_review(spark, sf))


@query
def report_all(spark, sf):
    """All report parts with the forest, written as one report and read again: (part, its row as text)."""
    folder = new_path(spark, "report")
    report.build_report(stored_retail(spark, sf)).write(folder)

    def row(part):
        return F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in sorted(part.columns)])

    tables = report.read_report(spark, folder).tables
    return reduce(DataFrame.unionByName, [
        part.select(F.lit(name).alias("part"), row(part).alias("content")) for name, part in tables.items()
    ])
