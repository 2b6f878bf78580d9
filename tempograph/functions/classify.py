"""Types of nodes and edges from what their properties hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_key(properties: Column, key: str) -> Column:
    """Whether a variant has a key, be its value null or not."""
    return F.variant_get(properties, f"$.{key}", "variant").isNotNull()


def node_type(properties: Column) -> Column:
    """hash and path: File; sql or connectionString: DatabaseRecord; stream: Stream; else Unknown."""
    has = lambda k: has_key(properties, k)
    return F.when(has("hash") & has("path"), "File").when(has("sql") | has("connectionString"), "DatabaseRecord").when(has("stream"), "Stream").otherwise("Unknown")


def base_name(path: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def edge_type(left: Column, right: Column) -> Column:
    """Equal hashes: DuplicateOf; base names of which one begins with the other: VersionOf; else DerivedFrom."""
    text = lambda p, k: F.variant_get(p, f"$.{k}", "string")
    a, b = base_name(text(left, "path")), base_name(text(right, "path"))
    version = has_key(left, "path") & has_key(right, "path") & (a.startswith(b) | b.startswith(a))
    duplicate = text(left, "hash") == text(right, "hash")
    return F.when(duplicate, "DuplicateOf").when(version, "VersionOf").otherwise("DerivedFrom")
