"""Reasons why a path or a text must not be published."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of sensitive content, in the order in which reasons are listed.
CONTENT = {
    "header": r"(?md)^\s*data\s*,\s*conversation\s*$",
    "ssn": r"(?U)\b\d{3}-\d{2}-\d{4}\b",
    "mrn": r"(?iU)\b(?:MRN|medical\s+record\s+(?:number|no\.?))\s*[:#]?\s*\d{5,}",
    "nhs": r"(?U)\b\d{3}[ -]\d{3}[ -]\d{4}\b",
    "dob": r"(?iU)\b(?:DOB|date\s+of\s+birth)\s*[:#]?\s*\d",
    "email": r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
}
TOP_FOLDERS = ("data", "models", "outputs")
FOLDER_PREFIX = "gold"
SUFFIXES = (".parquet", ".csv", ".jsonl")
#: Below this folder contents are not looked at; paths still are.
ALLOWED = "artifacts/eval"


def _reasons(tests: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())


def content_reasons(text: Column) -> Column:
    return _reasons({k: text.rlike(p) for k, p in CONTENT.items()})


def path_reasons(path: Column) -> Column:
    """By the first part, any folder, and the suffix of a relative path."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    suffix = F.lower(F.regexp_extract(F.element_at(parts, -1), r".(\.[^.]+)$", 1))
    return _reasons({
        "folder": F.get(parts, F.lit(0)).isin(*TOP_FOLDERS),
        "gold": F.exists(folders, lambda x: x.startswith(FOLDER_PREFIX)),
        "suffix": suffix.isin(*SUFFIXES),
    })


def reasons(path: Column, text: Column) -> Column:
    content = F.when(path.startswith(f"{ALLOWED}/"), F.array().cast("array<string>")).otherwise(content_reasons(text))
    return F.concat(path_reasons(path), content)
