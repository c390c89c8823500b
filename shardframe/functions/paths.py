"""Path and URI expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardframe.functions.numbers import as_col

_URI = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)(.*)$"


def uri_base(uri) -> Column:
    """``scheme://host`` of a URI, empty for a plain path."""
    return F.regexp_extract(as_col(uri), _URI, 1)


def uri_path(uri) -> Column:
    """Path of a URI, also right for plain paths (``parse_url`` needs a host)."""
    return F.regexp_extract(as_col(uri), _URI, 2)


def uri_rest(uri) -> Column:
    """Query and fragment of a URI with their marks."""
    return F.regexp_extract(as_col(uri), _URI, 3)


def uri_scheme(uri) -> Column:
    """Scheme of a URI, empty when absent."""
    return F.regexp_extract(as_col(uri), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)


def uri_host(uri) -> Column:
    """Host (with port) of a URI, empty for a plain path."""
    return F.regexp_extract(as_col(uri), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)


def append_path(uri, tail) -> Column:
    """Append a path to a URI's path with exactly one slash between; query and fragment stay last."""
    uri, tail = as_col(uri), F.regexp_replace(as_col(tail), r"^/+", "")
    joined = F.concat(F.regexp_replace(uri_path(uri), r"/+$", ""), F.lit("/"), tail)
    plain = F.regexp_replace(joined, r"(?<!^)/+$", "")
    rooted = F.when((uri_path(uri) == "") & (uri_base(uri) == ""), F.ltrim(plain, F.lit("/"))).otherwise(plain)
    return F.concat(uri_base(uri), rooted, uri_rest(uri))


def rel_path(uri) -> Column:
    """Path of a URI without host and without its first slash."""
    return F.regexp_replace(uri_path(uri), r"^/", "")


def trim_last_ext(path) -> Column:
    """Drop the last extension of the file name; leading dots are no extension."""
    return F.regexp_replace(as_col(path), r"^((?:.*/)?[^/]*[^/.][^/]*)\.[^/.]*$", "$1")


def path_parts(path) -> Column:
    """Non-empty components of a slash path."""
    return F.filter(F.split(as_col(path), "/"), lambda x: x != "")


def parts_to_path(parts: Column) -> Column:
    """Absolute path from its components."""
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def parent_path(path) -> Column:
    """Parent directory, null for the root."""
    parts = path_parts(path)
    return F.when(F.size(parts) > 0, parts_to_path(F.slice(parts, F.lit(1), F.size(parts) - 1)))


def base_name(path) -> Column:
    """Last component, null for the root."""
    return F.try_element_at(path_parts(path), F.lit(-1))


def ancestors(path) -> Column:
    """All proper ancestors of a path, root first."""
    parts = path_parts(path)
    return F.when(
        F.size(parts) > 0,
        F.transform(
            F.sequence(F.lit(0), F.size(parts) - 1),
            lambda i: parts_to_path(F.slice(parts, F.lit(1), i)),
        ),
    ).otherwise(F.array().cast("array<string>"))
