"""Text forms used by the method registry and by file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def params_text(params: Column) -> Column:
    """map<string,string> -> 'k1,k2:v1,v2' with the keys in order; NULL for an empty or NULL map."""
    entries = F.array_sort(F.map_entries(params))
    text = F.concat_ws(":",
                       F.concat_ws(",", F.transform(entries, lambda e: e["key"])),
                       F.concat_ws(",", F.transform(entries, lambda e: e["value"])))
    return F.when(F.size(params) > 0, text)


def position_key(lat: Column, lon: Column) -> Column:
    return F.concat_ws(",", lat.cast("string"), lon.cast("string"))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[\\/:*?"<>|]', "_")
