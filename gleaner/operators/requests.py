"""Request tables: what a job would ask for, one row per request, to be joined with captures."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import any_text, url_encode


def with_query(url: Column, params: Mapping[str, Column]) -> Column:
    """Append parameters as they are, after `?` or `&`."""
    if not params:
        return url
    pairs = F.concat_ws("&", *[F.concat(F.lit(f"{k}="), any_text(v)) for k, v in params.items()])
    return F.concat(url, F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), pairs)


def headers(given: Mapping[str, Column], user_agent: str, content_type: str | None = None) -> Column:
    """Header map; the job's own headers win over the defaults."""
    out = {**given}
    out.setdefault("User-Agent", F.lit(user_agent))
    if content_type:
        out.setdefault("Content-Type", F.lit(content_type))
    return F.create_map(*[x for k, v in out.items() for x in (F.lit(k), any_text(v))])


def form_body(fields: Mapping[str, Column]) -> Column:
    return F.concat_ws("&", *[F.concat(url_encode(F.lit(k)), F.lit("="), url_encode(any_text(v))) for k, v in fields.items()])


def json_body(fields: Mapping[str, Column]) -> Column:
    """A JSON object; columns may be structs and arrays. Nulls are written."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})
