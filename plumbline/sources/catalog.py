"""The dataset catalog as a DataFrame: fingerprints, newest copies, removal, refresh, search.

Catalog columns: id, file_name, file_path, rows_count, columns_count, and for content the pair
(content_length, content_sha).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.scalars import quoted
from plumbline.sources.rows import data_columns

CONTENT = ["content_length", "content_sha"]


def with_fingerprint(df: DataFrame, text: str) -> DataFrame:
    """Byte length and SHA-256 of a text column."""
    content = F.encode(F.col(text), "UTF-8")
    return df.select(
        *[quoted(c) for c in df.columns if c != text],
        F.octet_length(text).cast("bigint").alias("content_length"),
        F.sha2(content, 256).alias("content_sha"),
    )


def fingerprint_parts(columns: list[str]) -> list[Column]:
    """The aggregates of ``table_fingerprint``, for a pass that does something else besides."""
    cells = [
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
        for t in (quoted(n).cast("string") for n in columns)
    ]
    digest = F.md5(F.concat_ws(",", *cells).cast("binary"))

    def part(start: int) -> Column:
        return F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)"))

    return [F.count("*").alias("rows_count"), part(1).alias("hash_sum"), part(16).alias("second_hash_sum")]


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table of any size: row count and two sums over the rows' MD5.

    Cells are written with their length, missing ones marked, so different rows have different texts.
    """
    return df.agg(*fingerprint_parts(data_columns(df)))


def normal_path(path: Column) -> Column:
    """A slash path with '.', empty steps and '..' folded away; leading '..' that leave the start
    are kept as '..' steps."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))

    def fold(done: Column, step: Column) -> Column:
        up = (step == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
        return F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(
            F.concat(done, F.array(step))
        )

    folded = F.aggregate(steps, F.array().cast("array<string>"), fold)
    lead = F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    return F.concat(lead, F.array_join(folded, "/"))


def valid_paths(catalog: DataFrame, root: str = "uploads") -> DataFrame:
    """Records whose path stays strictly below the storage root."""
    return catalog.withColumn("resolved_path", normal_path(F.col("file_path"))).filter(
        F.startswith("resolved_path", F.lit(root.rstrip("/") + "/"))
    )


def latest_distinct(catalog: DataFrame, allowed_paths: DataFrame | None = None) -> DataFrame:
    """The newest record of each distinct content.

    The newest id per content is a pre-aggregated maximum, so a content copied a million times is
    one row per task before the shuffle; the records are then picked by their unique id.
    """
    if allowed_paths is not None:
        catalog = catalog.join(allowed_paths.select("file_path").distinct(), "file_path", "left_semi")
    readable = catalog.filter(F.col("content_sha").isNotNull())  # a record without content is no dataset
    newest = readable.groupBy(*CONTENT).agg(F.max("id").alias("id"))
    return catalog.join(newest.select("id"), "id", "left_semi")


def find_duplicates(uploads: DataFrame, catalog: DataFrame) -> DataFrame:
    """For every upload, the newest record with the same size, shape and content, or NULL.

    The catalog is reduced to one row per content before the join; a hot content on the upload
    side is split by the adaptive skew join.
    """
    keys = ["rows_count", "columns_count", *CONTENT]
    newest = catalog.groupBy(*keys).agg(F.max("id").alias("existing_id"))
    return uploads.join(newest, keys, "left").select("upload_id", "existing_id")


def identical_group(catalog: DataFrame, dataset_id: int) -> tuple[str, int]:
    """Content of the chosen record; an unknown id is an error."""
    chosen = catalog.filter(F.col("id") == dataset_id).select(*CONTENT).first()
    if chosen is None:
        raise ValueError(f"Dataset {dataset_id} is not in the catalog.")
    return chosen["content_sha"], chosen["content_length"]


def remove_group(catalog: DataFrame, dataset_id: int) -> DataFrame:
    """The catalog with a status per record: every copy of the chosen content is removed.

    One literal comparison per row: nothing is joined or shuffled.
    """
    sha, length = identical_group(catalog, dataset_id)
    same = F.coalesce((F.col("content_length") == length) & (F.col("content_sha") == sha), F.lit(False))
    return catalog.withColumn(
        "status", F.when(same | (F.col("id") == dataset_id), "removed").otherwise("kept")
    )


def removal_counts(marked: DataFrame) -> DataFrame:
    return marked.agg(
        F.count_if(F.col("status") == "removed").alias("deleted_records"),
        F.count_if(F.col("status") == "kept").alias("kept_records"),
    )


def refresh(catalog: DataFrame, sources: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Update the record whose path a source has, insert the other sources, keep the rest.

    Of several records with one path the one with the least id is updated.

    ``names`` may give a display name per path; otherwise the file name of the path is used. New
    records get their id from the store that saves them.
    """
    incoming = sources.select("file_path", "rows_count", "columns_count")
    if names is not None:
        incoming = incoming.join(names.select("file_path", "display_name"), "file_path", "left")
    else:
        incoming = incoming.withColumn("display_name", F.lit(None).cast("string"))
    incoming = incoming.select(
        "file_path",
        F.coalesce("display_name", F.substring_index("file_path", "/", -1)).alias("new_name"),
        F.col("rows_count").alias("new_rows"), F.col("columns_count").alias("new_columns"),
        F.lit(True).alias("refreshed"),
    )
    known = catalog.select("id", "file_name", "file_path", "rows_count", "columns_count", F.lit(True).alias("known"))
    first = known.groupBy("file_path").agg(F.min("id").alias("first_id"))
    known = known.join(first, "file_path").withColumn("slot", F.when(F.col("id") == F.col("first_id"), 0).otherwise(1))
    merged = known.join(incoming.withColumn("slot", F.lit(0)), ["file_path", "slot"], "full_outer")
    return merged.select(
        "id",
        F.coalesce("new_name", "file_name").alias("file_name"),
        "file_path",
        F.coalesce("new_rows", "rows_count").alias("rows_count"),
        F.coalesce("new_columns", "columns_count").alias("columns_count"),
        F.when(F.col("refreshed").isNull(), "kept").when(F.col("known").isNull(), "inserted")
        .otherwise("updated").alias("action"),
    )


def search(catalog: DataFrame, text: str, positions: DataFrame | None = None) -> DataFrame:
    """Names that contain the text in any case; user positions first, then newest first."""
    hits = catalog.filter(F.contains(F.lower("file_name"), F.lit(text.lower())))
    if positions is None:
        return hits.orderBy(F.col("id").desc())
    return hits.join(positions.select("id", "position"), "id", "left").orderBy(
        F.col("position").asc_nulls_last(), F.col("id").desc()
    )


def union_metadata(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
