"""Label, path and log-line text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes stripped from a dataset folder name, longest first.
DATASET_SUFFIXES = ("_unified_output_split", "_output_split", "_split")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_homepage(path: Column, prefix: str = "1_") -> Column:
    return base_name(path).startswith(prefix)


def page_type(path: Column) -> Column:
    """aggregate for batch captures, homepage / subpage for single-page ones."""
    group = F.regexp_extract(path, r"/(batch|single)/[^/]+/pcap/[^/]+$", 1)
    return (
        F.when(group == "batch", F.lit("aggregate"))
        .when((group == "single") & is_homepage(path), F.lit("homepage"))
        .when(group == "single", F.lit("subpage"))
    )


def site_label(path: Column) -> Column:
    return F.regexp_extract(path, r"/(?:batch|single)/([^/]+)/pcap/[^/]+$", 1)


def first_level_label(path: Column, root: str) -> Column:
    """Name of the first folder below ``root`` that contains ``path``."""
    inner = F.substring_index(path, root.rstrip("/") + "/", -1)
    return F.when(F.instr(inner, "/") > 0, F.substring_index(inner, "/", 1))


def is_capture_file(path: Column) -> Column:
    return F.lower(path).rlike(r"\.pcap(ng)?$")


def safe_label(label: Column) -> Column:
    return F.replace(label, F.lit("/"), F.lit("_"))


def display_label(label: Column, width: int = 35) -> Column:
    return F.when(
        F.length(label) > width, F.concat(F.substring(label, 1, width - 3), F.lit("..."))
    ).otherwise(label)


def label_or_default(label: Column, label_id: Column, style: str = "Unknown({})") -> Column:
    """``label``, or ``style`` filled with the id where it is missing."""
    before, after = style.split("{}")
    return F.coalesce(label, F.concat(F.lit(before), label_id.cast("string"), F.lit(after)))


def topk_dataset_name(name: Column, k: int | Column) -> Column:
    strip = "(" + "|".join(DATASET_SUFFIXES) + ")$"
    k_text = k.cast("string") if isinstance(k, Column) else F.lit(str(k))
    return F.concat(F.regexp_replace(name, strip, ""), F.lit("_top"), k_text, F.lit("_split"))


def flow_name(path: Column, ordinal: Column) -> Column:
    return F.concat_ws("_", base_name(path), ordinal.cast("string"))
