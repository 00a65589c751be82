"""Document discovery: folders of PDFs and remote listing manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blanks import squeeze, text_or_empty
from ..functions.dates import parse_iso_utc
from ..functions.identity import content_sha256, revision_of

PDF_MIME = "application/pdf"


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Direct PDF children of a folder as document references.

    Only path, time and length are read; the file content stays untouched.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    path = F.regexp_replace("path", r"^file:/+", "/")
    micros = F.unix_micros("modificationTime")
    refs = listed.select(
        F.lit("local").alias("source_type"), F.regexp_extract(path, r"([^/]+)$", 1).alias("display_name"),
        path.alias("uri"), path.alias("source_id"), F.concat_ws(":", micros * 1000, "length").alias("revision_id"),
        F.lit(PDF_MIME).alias("mime_type"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"),
        F.create_map(F.lit("local_kind"), F.lit("file"), F.lit("discovered_via"), F.lit("folder")).alias("metadata"),
    )
    if refs.isEmpty():
        raise ValueError(f"No PDFs found in {folder}")
    return refs.orderBy(F.lower("display_name"))


def document_digests(spark: SparkSession, folder: str) -> DataFrame:
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return listed.select("path", content_sha256(F.col("content")).alias("content_sha256"))


MANIFEST_SCHEMA = (
    "id string, name string, mimeType string, size string, modifiedTime string, md5Checksum string, "
    "headRevisionId string, webViewLink string, trashed boolean, folder string"
)


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Listing pages written as JSON lines by whatever lists the remote folder."""
    return spark.read.schema(MANIFEST_SCHEMA).json(path)


def manifest_refs(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs, rejects): PDFs not in the bin; rows without id or name are rejects."""
    kept = listing.filter((F.col("mimeType") == PDF_MIME) & ~F.coalesce("trashed", F.lit(False)))
    named = (squeeze(text_or_empty(F.col("id"))) != "") & (squeeze(text_or_empty(F.col("name"))) != "")
    source = squeeze(F.col("id"))
    refs = kept.filter(named).select(
        F.lit("google_drive").alias("source_type"), squeeze(F.col("name")).alias("display_name"),
        F.concat(F.lit("gdrive://"), source).alias("uri"), source.alias("source_id"),
        revision_of(F.col("headRevisionId"), F.col("md5Checksum"), F.col("modifiedTime")).alias("revision_id"),
        F.col("mimeType").alias("mime_type"), F.col("size").try_cast("bigint").alias("size_bytes"),
        parse_iso_utc(F.col("modifiedTime")).alias("modified_at"),
        F.create_map(F.lit("drive_folder_id"), F.col("folder"), F.lit("web_view_link"), F.col("webViewLink")).alias("metadata"),
    )
    return refs.orderBy(F.lower("display_name")), kept.filter(~named)


def exclude_outputs(refs: DataFrame, output_prefix: str) -> DataFrame:
    """Results are never listed as inputs again."""
    return refs.filter(~F.col("uri").startswith(output_prefix.rstrip("/") + "/"))
