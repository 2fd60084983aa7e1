"""Reading raw documents, writing versioned snapshots, and checking them against an accepted one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer import constants as K

RAW_RECORD = (
    "raw_record_id string, source_document string, section string, reference_number string, "
    "reference_number_raw string, original_substance_name string, cas_number_raw string, "
    "original_field_of_use_text string, original_concentration_text string, original_conditions_text string, "
    "original_warning_text string, source_text string, source_pages array<int>, "
    "fragments array<struct<source_page:int,table_bbox:array<double>,row_bbox:array<double>,cells:array<string>,"
    "original_row_text:string,is_continuation:boolean>>, "
    "footnote_references array<string>, jurisdiction_notes array<string>, extraction_flags array<string>"
)
RAW_DOCUMENT = f"dataset_version string, source_document string, section string, records array<struct<{RAW_RECORD.replace(' string', ':string').replace(' array', ':array')}>>"


def read_source_files(spark: SparkSession, path: str, name: str = r"([^/]+?)(?:\.[^./]*)?$") -> DataFrame:
    """(source_document, content) of files; the first group of ``name`` in the path identifies the document."""
    return spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", name, 1).alias("source_document"), "content"
    )


MANIFEST_FIELDS = ("authority", "source_url", "document_revision", "effective_date", "retrieval_date")


def source_manifest(documents: DataFrame, definitions: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row per source document: content hash, size and page count, joined to its definition.

    definitions: source_document, some of MANIFEST_FIELDS, and any others, which become the map ``metadata``. pages:
    (source_document, source_page) of the documents that have pages.
    """
    known = [c for c in MANIFEST_FIELDS if c in definitions.columns]
    others = [c for c in definitions.columns if c not in known and c != "source_document"]
    rows = documents.select(
        "source_document",
        F.sha2(F.col("content"), 256).alias("sha256"),
        F.length("content").cast("bigint").alias("content_bytes"),
    ).join(definitions, "source_document")
    counted = F.lit(None).cast("bigint")
    if pages is not None:
        # pages once each, counted map-side
        counts = pages.select("source_document", "source_page").distinct().groupBy("source_document").agg(F.count("*").alias("_pages"))
        rows = rows.join(counts, "source_document", "left")
        counted = F.col("_pages")
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in sorted(others)])
    metadata = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())) if others else F.create_map().cast("map<string,string>")
    return rows.select(
        "source_document", "sha256", "content_bytes", counted.alias("page_count"), *known, metadata.alias("metadata")
    )


def load_raw_records(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Records of raw JSON documents (one object per file), tagged with section and source."""
    documents = spark.read.schema(RAW_DOCUMENT).json(path, multiLine=True)
    return tag_records(documents, manifest)


def tag_records(documents: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Explode ``records`` and attach the document's version and source row."""
    rows = documents.select("dataset_version", "source_document", "section", F.explode("records").alias("r"))
    fields = [f for f in documents.schema["records"].dataType.elementType.names if f not in ("source_document", "section")]
    rows = rows.select("dataset_version", "source_document", "section", *[F.col(f"r.{f}") for f in fields])
    return rows if manifest is None else rows.join(manifest, "source_document")


def snapshot_sink(df: DataFrame, path: str, dataset_version: str, order: list[str], mode: str = "errorifexists") -> None:
    """Write one dataset version; rows are ordered within files so that reruns give equal files."""
    (
        df.withColumn("dataset_version", F.lit(dataset_version))
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .partitionBy("dataset_version")
        .parquet(path)
    )


def content_digest(columns: list[str]) -> Column:
    """SHA-256 of a row: every column in the given order, with its length, null apart from ''."""
    shown = [F.col(c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in shown]), 256)


def row_fingerprint(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Order-free content hash of a table, or of each group ``by``: row_count and fingerprint.

    The four quarters of the rows' SHA-256 are summed, so it combines map-side and depends on every value and on how
    often a row occurs, but not on the order; up to 1e18 rows.
    """
    rows = df.select(*(by or []), content_digest(sorted(df.columns)).alias("_digest"))
    quarters = [F.sum(F.conv(F.substring("_digest", at, 16), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 17, 33, 49)]
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("row_count"), F.concat_ws("-", *[F.coalesce(q, F.lit("0")) for q in quarters]).alias("fingerprint")
    )


def content_fingerprint(current: DataFrame, accepted: DataFrame) -> DataFrame:
    """Compare (item, fingerprint) of now with the accepted ones: same, changed, missing, extra."""
    both = accepted.select("item", F.col("fingerprint").alias("_accepted")).join(current, "item", "full_outer")
    status = (
        F.when(F.col("fingerprint").isNull(), "missing")
        .when(F.col("_accepted").isNull(), "extra")
        .when(F.col("fingerprint") != F.col("_accepted"), "changed")
        .otherwise("same")
    )
    return both.select("item", status.alias("status"))


def version_consistency(versions: DataFrame, accepted: str | None = None) -> DataFrame:
    """(source_table, dataset_version, row_count) that differ from the accepted version.

    ``versions`` has one row per table row or document. Without an accepted version all groups are listed.
    """
    counts = versions.groupBy("source_table", "dataset_version").agg(F.count("*").alias("row_count"))
    if accepted is None:
        return counts
    return counts.filter(F.coalesce("dataset_version", F.lit("")) != accepted)
