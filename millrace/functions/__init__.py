"""Column functions over text that holds JSON or URLs; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_long(column: str, path: str) -> Column:
    """An integer at a JSON path; null where the text is no JSON or the value no integer."""
    return F.get_json_object(column, path).try_cast("long")


def url_host(column: str) -> Column:
    """The host of a URL, null where it has none or is no URL."""
    return F.try_parse_url(F.col(column), F.lit("HOST"))


def page_title(column: str) -> Column:
    """What stands in a page's first title element, empty where it has none."""
    return F.regexp_extract(column, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
