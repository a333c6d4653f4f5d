"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capsieve.functions.text import casefold

# File suffixes that count as video.
VIDEO_SUFFIXES = (
    ".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".webm", ".m4v", ".ts", ".m2ts", ".mts",
    ".ogv", ".mpg", ".mpeg", ".3gp", ".rmvb", ".rm", ".vob", ".asf", ".f4v", ".divx",
)

_SUFFIX = r"[^/\\](\.[^./\\]+)$"


def suffix(path: Column) -> Column:
    """Last suffix with its dot; a leading dot does not start one."""
    return F.regexp_extract(path, _SUFFIX, 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"(?<=.)\.[^.]+$", "")


def is_video(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*VIDEO_SUFFIXES)


def target_path(path: Column) -> Column:
    """The path with its last suffix replaced by ``.txt``."""
    return F.regexp_replace(path, r"(?<=[^/\\])\.[^./\\]+$", ".txt")


def fold_key(path: Column) -> Column:
    return casefold(path)


def stem_terms(path: Column) -> Column:
    """ASCII letter-digit runs of the file stem that hold a letter."""
    runs = F.regexp_extract_all(stem(path), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.filter(runs, lambda run: run.rlike("[A-Za-z]"))
