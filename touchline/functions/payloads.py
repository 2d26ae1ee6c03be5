"""JSON payload and link functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.scalars import _col

# Where a match link may carry its event id.
LINK_QUERY_KEYS = ["id", "eventId", "event_id"]
LINK_FRAGMENT_PATTERNS = [r"(?i)(?:^|[&])id:(\d+)(?:$|[&])", r"(?i)(?:^|[&])id=(\d+)(?:$|[&])"]
LINK_PATH_PATTERN = r"(?i)/event/(\d+)(?:/|$)"
MESSAGE_VERSION = "1.0"


def json_path(payload, path: str, cast: str = "string", default=None) -> Column:
    """Value at a JSON path, null when any step is missing."""
    value = F.get_json_object(_col(payload), "$." + path).try_cast(cast)
    return value if default is None else F.coalesce(value, F.lit(default))


def canonical_json(payload) -> Column:
    """JSON text with sorted keys and no spaces; null when it does not parse."""
    return F.to_json(F.try_parse_json(_col(payload)))


def payload_hash(payload) -> Column:
    """order-independent content hash of a JSON payload."""
    return F.sha2(canonical_json(payload), 256)


def message_id(event_id, payload) -> Column:
    """idempotent message id, equal for equal content."""
    return F.concat_ws(":", _col(event_id).cast("string"), payload_hash(payload))


def envelope(event_id, payload, observed_at) -> Column:
    """live message envelope as a struct."""
    return F.struct(
        F.lit(MESSAGE_VERSION).alias("schema_version"),
        message_id(event_id, payload).alias("message_id"),
        _col(event_id).cast("bigint").alias("event_id"),
        _col(observed_at).cast("string").alias("observed_at"),
        _col(payload).alias("payload"),
    )


def row_json(*columns) -> Column:
    """row as JSON text."""
    return F.to_json(F.struct(*[_col(c) for c in (columns or ("*",))]))


def match_link(slug, custom_id, event_id, base: str) -> Column:
    """public link of an event, null when slug or custom id is missing."""
    return F.when(
        _col(slug).isNotNull() & _col(custom_id).isNotNull(),
        F.concat(
            F.lit(base.rstrip("/") + "/"), _col(slug), F.lit("/"), _col(custom_id),
            F.lit("#id:"), _col(event_id).cast("string"),
        ),
    )


def link_event_id(url, hosts: Sequence[str]) -> Column:
    """event id of a match link on one of ``hosts``; null when there is none.

    Looked for in the query, then the fragment, then the path.
    """
    text = F.trim(_col(url))
    host = F.lower(F.try_parse_url(text, F.lit("HOST")))
    scheme = F.lower(F.try_parse_url(text, F.lit("PROTOCOL")))
    query = F.coalesce(F.try_parse_url(text, F.lit("QUERY")), F.lit(""))
    fragment = F.coalesce(F.try_parse_url(text, F.lit("REF")), F.lit(""))
    path = F.coalesce(F.try_parse_url(text, F.lit("PATH")), F.lit(""))
    candidates = [F.regexp_extract(query, rf"(?:^|&){key}=(\d+)(?:$|&)", 1) for key in LINK_QUERY_KEYS]
    candidates += [F.regexp_extract(fragment, pattern, 1) for pattern in LINK_FRAGMENT_PATTERNS]
    candidates.append(F.regexp_extract(path, LINK_PATH_PATTERN, 1))
    found = F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])
    allowed = scheme.isin("http", "https") & host.isin(*[h.lower() for h in hosts])
    return F.when(allowed, found.try_cast("bigint"))


def link_problem(url, hosts: Sequence[str]) -> Column:
    """reject reason of a link, null for a usable one."""
    text = F.trim(_col(url))
    host = F.lower(F.try_parse_url(text, F.lit("HOST")))
    scheme = F.lower(F.try_parse_url(text, F.lit("PROTOCOL")))
    allowed = scheme.isin("http", "https") & host.isin(*[h.lower() for h in hosts])
    return F.when(~F.coalesce(allowed, F.lit(False)), "not a supported match link").when(
        link_event_id(url, hosts).isNull(), "link has no event id"
    )
