"""Report tables: the profile, quality and anomaly results put together."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline import constants as K
from plumbline.functions.scalars import display_label, number_text, report_text
from plumbline.operators.anomaly import Review, anomaly_queue, method_counts, retail_context, review
from plumbline.operators.explain import evidence_entries, interpretation
from plumbline.operators.profile import column_profile
from plumbline.operators.quality import (
    Assessment,
    assess,
    consistency_checks,
    overall_quality,
    quality_dimensions,
    quality_issues,
    severity_rank,
)
from plumbline.sources.rows import ROW_NUMBER
from plumbline.sources.storage import delete_folder, folder_exists, folders_below, pin, replace_file


def _fold(*facts: DataFrame) -> DataFrame:
    """One-row facts side by side, without a join: their columns differ, so a maximum keeps each."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    return union.agg(*[F.max(name).alias(name) for name in union.columns])


def _grade_text(grade: Column) -> Column:
    return F.when(grade.isNull(), K.NO_GRADE).otherwise(
        F.concat(F.initcap(F.replace(grade, F.lit("_"), F.lit(" "))), F.lit(K.GRADE_SUFFIX))
    )


def report_headline(assessment: Assessment, found: Review) -> DataFrame:
    """Score with its breakdown, grade, size, missing cells, duplicates, flagged rows, severe findings."""
    issues = quality_issues(assessment).filter(F.col("severity") == "high")
    facts = _fold(
        overall_quality(assessment).select(
            "rows_count", "overall_quality_score", "quality_grade", "weighted_mean", "limiting_dimension",
            "limiting_dimension_score"),
        assessment.scores.select("missing_values", "duplicate_rows"),
        found.flagged.agg(F.count("*").alias("flagged_rows")),
        issues.agg(
            F.count("*").alias("high_findings"), F.min_by("message", "ordinal").alias("first_high_finding")
        ),
    )
    score = F.col("overall_quality_score")
    return facts.select(
        F.when(score.isNull(), "Not evaluated")
        .otherwise(F.concat(F.format_number(score, 2), F.lit(" / 100"))).alias("score"),
        _grade_text(F.col("quality_grade")).alias("grade"),
        number_text(F.col("rows_count")).alias("rows"),
        number_text(F.lit(len(assessment.names))).alias("columns"),
        number_text(F.coalesce("missing_values", F.lit(0))).alias("missing_cells"),
        number_text(F.col("duplicate_rows")).alias("duplicate_rows"),
        (number_text(F.col("flagged_rows")) if found.evaluated else F.lit("Not evaluated")).alias("flagged_rows"),
        "high_findings", "first_high_finding", "weighted_mean", "limiting_dimension", "limiting_dimension_score",
    )


def report_dimensions(assessment: Assessment) -> DataFrame:
    score = F.col("score")
    evaluated = F.when(score.isNull(), "Not evaluated")
    return quality_dimensions(assessment).select(
        "ordinal",
        F.initcap("dimension").alias("dimension"),
        F.concat(F.format_number(F.col("weight") * 100, 0), F.lit("%")).alias("weight"),
        evaluated.otherwise(F.concat(F.format_number(score, 2), F.lit(" / 100"))).alias("score"),
        F.coalesce("reason", evaluated.otherwise("Evaluated")).alias("reason"),
    )


def report_findings(assessment: Assessment) -> DataFrame:
    """All findings, the most urgent first. Issues are bounded by the schema."""
    issues = quality_issues(assessment)
    whole = Window.orderBy(severity_rank(F.col("severity")), F.col("affected_records").desc(), "ordinal")
    area = F.concat_ws(" / ", F.initcap("dimension"), F.col("column_name"))
    return (
        issues.withColumn("position", F.row_number().over(whole).cast("bigint"))
        .select("position", F.initcap("severity").alias("severity"), area.alias("area"),
                number_text(F.col("affected_records")).alias("affected"),
                report_text(F.col("message")).alias("evidence"))
    )


def report_columns(profile: DataFrame) -> DataFrame:
    """All columns in source order."""
    missing = F.concat(
        number_text(F.col("missing_count")), F.lit(" ("), F.format_number("missing_percentage", 2), F.lit("%)")
    )
    return profile.select(
        "ordinal", report_text(F.col("column_name")).alias("column_name"), F.initcap("logical_type").alias("type"),
        missing.alias("missing"), number_text(F.col("unique_count")).alias("unique"),
    )


def report_methods(counts: DataFrame) -> DataFrame:
    """All method and field rows with flags or the reason for none."""
    flags = F.when(F.col("status") == "evaluated", number_text(F.col("flagged_rows"))).otherwise("Not evaluated")
    return counts.select(
        "ordinal", display_label(F.col("method")).alias("method"), F.col("field").alias("fields"),
        flags.alias("flags"), F.coalesce("reason", F.lit("Evaluated")).alias("reason"),
    )


def report_notes(assessment: Assessment) -> DataFrame:
    """(ordinal, note): matched fields, validity inputs, comparisons, concentrated missing cells."""
    roles = assessment.roles
    frame = assessment.scores.filter(F.col("rows_count") > 0)
    notes = []
    if roles.matches:
        listed = "; ".join(f"{r.replace('_', ' ')}: {c}" for r, c in roles.matches.items())
        notes.append(frame.select(F.lit(1).alias("ordinal"), report_text(
            F.lit(listed)).alias("text")).select("ordinal", F.concat(
                F.lit(K.MATCHES_NOTE[0]), "text", F.lit(K.MATCHES_NOTE[1])).alias("note")))
    if roles.has("quantity", "unit_price"):
        share = F.round(100.0 * F.col("complete_rows") / F.col("rows_count"), 2)
        notes.append(frame.filter(F.col("validity").isNotNull()).select(F.lit(2).alias("ordinal"), F.concat(
            F.lit(K.INPUTS_NOTE[0]), number_text(F.col("complete_rows")), F.lit(K.INPUTS_NOTE[1]),
            F.format_number(share, 2), F.lit(K.INPUTS_NOTE[2])).alias("note")))
    compared = F.when(
        F.col("coverage_percentage").isNotNull(),
        F.concat(F.lit(", "), F.format_number("coverage_percentage", 2), F.lit("% of rows compared")),
    ).otherwise("")
    entry = F.concat(
        F.replace("rule", F.lit("_"), F.lit(" ")), F.lit(": "), number_text(F.col("checked")), F.lit(" checked, "),
        number_text(F.col("affected")), F.lit(" inconsistent"), compared)
    order = F.when(F.col("rule") == "product_description", 1).otherwise(2)  # at most two rules
    notes.append(
        consistency_checks(assessment)
        .agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), entry.alias("entry")))).alias("entries"))
        .filter(F.size("entries") > 0)
        .select(F.lit(3).alias("ordinal"), F.concat(
            F.lit(K.COMPARISONS_NOTE[0]), F.array_join("entries.entry", "; "),
            F.lit(K.COMPARISONS_NOTE[1])).alias("note")))
    pieces = K.CONCENTRATION_NOTE
    notes.append(frame.filter(F.col("worst").isNotNull()).select(F.lit(4).alias("ordinal"), F.concat(
        F.lit(pieces[0]), F.format_number(F.round("coverage", 2), 2), F.lit(pieces[1]),
        report_text(F.col("worst.name")), F.lit(pieces[2]),
        F.format_number(F.round("worst_percent", 2), 2), F.lit(pieces[3]),
        F.format_number(F.round("penalty", 2), 2), F.lit(pieces[4])).alias("note")))
    return reduce(DataFrame.unionByName, notes)


def report_examples(found: Review, limit: int = K.REPORT_EXAMPLES) -> DataFrame:
    """The first rows of the review order with their reading and evidence."""
    reading = interpretation(found)
    first = anomaly_queue(found).limit(limit)
    return first.select(
        ROW_NUMBER,
        F.initcap(F.replace(reading["category"], F.lit("_"), F.lit(" "))).alias("category"),
        reading["message"].alias("message"),
        F.array_join(F.transform(evidence_entries(found), lambda e: e["message"]), "; ").alias("evidence"),
        reading["next_step"].alias("next_step"),
    )


MANIFEST = "manifest.json"
ORDERED_BY = {"dimensions": "ordinal", "notes": "ordinal", "findings": "position", "columns": "ordinal", "methods": "ordinal"}


@dataclass(frozen=True)
class Report:
    tables: dict[str, DataFrame]

    def write(self, folder: str) -> str:
        """All parts as Parquet tables of one version; its name.

        The version counts once its manifest has replaced the last one, in one step and after all parts
        are written. A write that fails leaves the last report as it was. The version before stays for
        those who still read it; earlier ones are deleted.
        """
        spark = next(iter(self.tables.values())).sparkSession
        last = _manifest(spark, folder)
        version = uuid.uuid4().hex
        try:
            for name, table in self.tables.items():
                table.write.parquet(f"{folder}/{version}/{name}")
            replace_file(spark, f"{folder}/{MANIFEST}", json.dumps({"version": version, "parts": list(self.tables)}))
        except BaseException:
            delete_folder(spark, f"{folder}/{version}")
            raise
        for name in folders_below(spark, folder):
            if name not in (version, last and last["version"]):
                delete_folder(spark, f"{folder}/{name}")
        return version

    def markdown(self, limit: int | None = None) -> str:
        """A text rendering of the first ``limit`` rows of each table, all of them by default; what a
        limit leaves out is counted. The tables are bounded by the schema."""
        parts = ["# Dataset quality assessment"]
        for name, table in self.tables.items():
            parts += ["", f"## {name.replace('_', ' ').capitalize()}", "",
                      "| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
            rows = table.collect()
            for row in rows[:limit]:
                parts.append("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in row) + " |")
            if limit is not None and len(rows) > limit:
                parts.append(f"\n{len(rows) - limit} more rows")
        return "\n".join(parts) + "\n"


def _manifest(spark: SparkSession, folder: str) -> dict | None:
    path = f"{folder}/{MANIFEST}"
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if folder_exists(spark, path) else None


def read_report(spark: SparkSession, folder: str) -> Report:
    """The report that the manifest names, its tables in their order."""
    found = _manifest(spark, folder)
    if found is None:
        raise ValueError(f"{folder} holds no report.")
    tables = {name: spark.read.parquet(f"{folder}/{found['version']}/{name}") for name in found["parts"]}
    return Report({n: t.orderBy(ORDERED_BY[n]) if n in ORDERED_BY else t for n, t in tables.items()})


def build_report(df: DataFrame, with_forest: bool = True) -> Report:
    """All report tables of a numbered table. Facts and flags are computed once and shared.

    Quality, anomalies and profile do not depend on each other, so their jobs run side by side.
    """
    with ThreadPoolExecutor(3) as pool:
        quality = pool.submit(inheritable_thread_target(df.sparkSession)(lambda: assess(df).pinned()))
        anomalies = pool.submit(inheritable_thread_target(df.sparkSession)(lambda: review(df, with_forest)))
        columns = pool.submit(inheritable_thread_target(df.sparkSession)(lambda: column_profile(df)))
        assessment, found, profile = quality.result(), anomalies.result(), columns.result()
    counts = pin(method_counts(found))
    tables = {
        "headline": report_headline(assessment, found),
        "dimensions": report_dimensions(assessment).orderBy("ordinal"),
        "notes": report_notes(assessment).orderBy("ordinal"),
        "findings": report_findings(assessment).orderBy("position"),
        "columns": report_columns(profile).orderBy("ordinal"),
        "methods": report_methods(counts).orderBy("ordinal"),
        "examples": report_examples(found),
    }
    context = retail_context(found)
    if context is not None:
        tables["retail_context"] = context
    return Report(tables)


