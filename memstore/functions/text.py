"""Small text functions."""

from __future__ import annotations

import secrets
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def shortened(c: Column, most: int) -> Column:
    """At most `most` characters, the last one an ellipsis where something was cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def key_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def key_preview(c: Column) -> Column:
    return shortened(c, 120)


def metadata_text(metadata: Column, field: str) -> Column:
    """The string at the field of a JSON object, lower-cased; null for other kinds."""
    v = F.try_variant_get(F.try_parse_json(metadata), f"$.{field}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.lower(F.variant_get(v, "$", "string")))


def ulid(now_ms: int | None = None) -> str:
    """26 characters: 48 bits of milliseconds and 80 random bits, sortable by time."""
    n = (int(time.time() * 1000) if now_ms is None else now_ms) << 80 | secrets.randbits(80)
    return "".join(_CROCKFORD[n >> 5 * i & 31] for i in range(25, -1, -1))


def ulid_column(now_ms: int) -> Column:
    """A ulid for each row, made on the executors: the time's ten characters, then 16 random ones.

    Random, so write the rows before they are read twice."""
    head = "".join(_CROCKFORD[now_ms >> 5 * i & 31] for i in range(9, -1, -1))
    bits = F.lpad(F.conv(F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 10), 16, 32), 8, "0")
    bits2 = F.lpad(F.conv(F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 10), 16, 32), 8, "0")
    return F.concat(F.lit(head), F.translate(F.upper(F.concat(bits, bits2)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _CROCKFORD))
