"""Stable names, hashes and keys for documents and runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .blanks import keep_if_filled, squeeze

_PDF_SUFFIX = r"(?i)\.pdf$"
_STEM_SUFFIX = r"(?<=[^/])\.[^./]+$"


def match_key(label: Column) -> Column:
    """Loose file-name key: no ``.pdf``, lower case, letters and digits only."""
    base = F.regexp_replace(squeeze(label), _PDF_SUFFIX, "")
    return F.regexp_replace(F.lower(base), "[^a-z0-9]+", "")


def safe_stem(display_name: Column, max_len: int = 64) -> Column:
    """File stem usable in paths, never empty."""
    stem = F.regexp_replace(display_name, _STEM_SUFFIX, "")
    dashed = F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, max_len), "-+$", "")
    return F.coalesce(keep_if_filled(cut), F.lit("document"))


def short_hash(identity: Column) -> Column:
    """First 12 hex digits of the SHA-256 of an identity string."""
    return F.substring(F.sha2(identity, 256), 1, 12)


def local_source_hash(path: Column, mtime: Column, size: Column) -> Column:
    return short_hash(F.concat_ws(":", F.lit("local"), path, mtime, size))


def drive_source_hash(source_id: Column, revision: Column) -> Column:
    known = F.coalesce(keep_if_filled(revision), F.lit("unknown"))
    return short_hash(F.concat_ws(":", F.lit("google_drive"), source_id, known))


def revision_of(head: Column, md5: Column, modified: Column) -> Column:
    """First filled of head revision, checksum and modification time."""
    return F.coalesce(keep_if_filled(head), keep_if_filled(md5), modified)


def run_id(created: Column, display_name: Column, source_hash: Column) -> Column:
    stamp = F.date_format(created, "yyyyMMdd'T'HHmmssSSSSSS'Z'")
    return F.concat_ws("-", stamp, safe_stem(display_name), source_hash)


def dedup_key(source_id: Column, uri: Column, revision: Column) -> Column:
    """One key per document revision."""
    return F.concat(
        F.coalesce(keep_if_filled(source_id), uri),
        F.lit("#"),
        F.coalesce(keep_if_filled(revision), F.lit("norev")),
    )


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)
