"""Percent-decoding of a value, tolerant of bad input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden.schema import DEFAULT_DECODE_PASSES


def decode_once(value: Column) -> Column:
    """Percent-decode once: a bad escape stays, ``+`` is itself, bad UTF-8 becomes U+FFFD."""
    strict = F.replace(F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    # The first byte of an encoded surrogate is bad by itself, so that each of its bytes counts.
    strict = F.regexp_replace(strict, "%[Ee][Dd](?=%[ABab])", "%FF")
    return F.when(F.contains(value, F.lit("%")), F.url_decode(strict)).otherwise(value)


def decode_variants(value: Column, passes: int = DEFAULT_DECODE_PASSES) -> Column:
    """The value, then each further decoded form, without repeats."""
    forms = [value]
    for _ in range(passes):
        forms.append(decode_once(forms[-1]))
    return F.array_distinct(F.array(*forms))
