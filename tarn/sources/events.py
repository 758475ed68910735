"""Scan events as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_text(path: Column) -> Column:
    """Path bytes as text: a byte outside printable ASCII is the character of its number (JSON writes it as \\u00HH)."""
    return F.decode(path.cast("binary"), "ISO-8859-1")


def finding_events(found: DataFrame, source: str, path_col: str = "object_id") -> DataFrame:
    """One JSON object a line, keys in fixed order; start and end are those of the whole match in the file."""
    event = F.struct(
        F.lit("finding").alias("type"), F.lit(source).alias("source"), path_text(F.col(path_col)).alias("path"),
        F.col("root_start").alias("start"), F.col("root_end").alias("end"), "rule_id", "rule",
    )
    return found.select(F.to_json(event).alias("value"))


def summary_event(source: str, status: str, elapsed_ms: int, size: int, findings: int, errors: int = 0) -> dict:
    return {"type": "summary", "source": source, "status": status, "elapsed_ms": elapsed_ms, "bytes": size, "findings": findings, "errors": errors, "throughput_mib_s": round(size / 1048576 / max(elapsed_ms, 1) * 1000, 2)}


def progress_event(source: str, stage: str, objects: int, size: int, findings: int) -> dict:
    return {"type": "progress", "source": source, "stage": stage, "objects": objects, "bytes": size, "findings": findings}


def diagnostic_event(level: str, message: str) -> dict:
    return {"type": "diagnostic", "level": level, "message": message}


def write_jsonl(found: DataFrame, source: str, path: str) -> None:
    finding_events(found, source).write.text(path)
