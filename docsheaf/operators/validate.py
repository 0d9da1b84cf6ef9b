"""Upload checks as ordered conditional expressions: cheap tests first, no decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File signatures (hex) and their type, in the order they are tested; the messages below are fixed too.
SIGNATURES = (("FFD8FF", "image"), ("89504E470D0A1A0A", "image"), ("474946383761", "image"), ("474946383961", "image"), ("424D", "image"), ("49492A00", "image"), ("4D4D002A", "image"))
PDF_SIGNATURE, RIFF, WEBP = "255044462D", "52494646", "57454250"


def _hex(value: str) -> Column:
    return F.unhex(F.lit(value))


def detect_type(header: Column) -> Column:
    """image, pdf or unknown from the first 32 bytes."""
    head = F.substring(header, 1, 32)
    out = None
    for signature, kind in SIGNATURES:
        test = F.startswith(head, _hex(signature))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    webp = F.startswith(head, _hex(RIFF)) & (F.octet_length(head) >= 12) & (F.substring(head, 9, 4) == _hex(WEBP))
    return out.when(webp, "image").when(F.startswith(head, _hex(PDF_SIGNATURE)), "pdf").otherwise("unknown")


def check_file(size: Column, header: Column, expected: str, max_mb: int) -> Column:
    """The first failed check's message, or ok. A size at the limit passes."""
    kind = detect_type(header)
    tenths = F.round(size / F.lit(1048576.0), 1).cast("decimal(20,1)").cast("string")
    return (
        F.when(size == 0, "File is empty")
        .when(size > max_mb * 1024 * 1024, F.concat(F.lit("File too large: "), tenths, F.lit(f"MB (max {max_mb}MB)")))
        .when(kind == "unknown", "Unknown or unsupported file type")
        .when(kind != expected, F.concat(F.lit(f"File type mismatch: expected {expected}, detected "), kind))
        .otherwise("ok")
    )


def check_dpi(dpi: Column) -> Column:
    return dpi.between(72, 600)


def safe_name(name: Column) -> Column:
    """The last path segment, trailing slashes and dot segments taken off."""
    return F.regexp_extract(F.regexp_replace(name, r"(/\.?)+$", ""), r"([^/]*)$", 1)


def check_name(name: Column) -> Column:
    base = safe_name(name)
    return (
        F.when(name.isNull() | (name == ""), "Filename cannot be empty").when((base == "") | (base == "."), "Invalid filename")
        .when(F.contains(base, F.lit("..")) | F.startswith(base, F.lit(".")), "Invalid filename pattern")
        .when(F.char_length(base) > 255, "Filename too long (max 255 characters)").otherwise("ok")
    )


def stored_name(job_id: Column, name: Column) -> Column:
    """``{job_id}{suffix}``; a name without a suffix is stored as .png."""
    suffix = F.regexp_extract(safe_name(name), r"^.+(\.[^.]+)$", 1)
    return F.concat(job_id.cast("string"), F.when(suffix == "", ".png").otherwise(suffix))


def submit(code: Column, name_check: Column, file_check: Column) -> Column:
    """HTTP-like result of an upload: the engine gate first, then name and file (400), else 202."""
    return F.when(code != 202, code).when((name_check != "ok") | (file_check != "ok"), 400).otherwise(202).cast("long")
