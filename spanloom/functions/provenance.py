"""What a result was made with: algorithm, revision, units and a hash of the options.

A provenance block is the same for all rows of a query, so it is attached once as a literal.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import jcs

UNITS = {"text": "utf16-code-unit", "spans": "half-open"}


@lru_cache(64)
def fnv1a32(text: str) -> str:
    """32-bit FNV-1a over whole UTF-16 code units, as ``fnv1a32:`` and eight digits."""
    h = 0x811C9DC5
    raw = text.encode("utf-16-le", "surrogatepass")
    for unit in (raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)):
        h = (h ^ unit) * 0x01000193 % 2**32
    return f"fnv1a32:{h:08x}"


def plain(value: object) -> object:
    """Options as JSON values: numbers that are not finite become null, sets sorted lists, bytes lists."""
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items() if not callable(v)}
    if isinstance(value, set | frozenset):
        return sorted(map(plain, value), key=repr)
    if isinstance(value, bytes | list | tuple):
        return [plain(v) for v in value]
    return value


def config_hash(options: Mapping) -> str:
    return fnv1a32(jcs(plain(options)))


def provenance(name: str, spec: str, revision: str, options: Mapping, units: Mapping[str, str] = UNITS) -> dict:
    return {
        "unicodeVersion": unicodedata.unidata_version,
        "algorithm": {"name": name, "spec": spec, "revisionOrDate": revision, "implementationId": "spanloom"},
        "configHash": config_hash(options),
        "units": dict(units),
    }


def literal(block: Mapping) -> Column:
    """A provenance block as a literal struct."""
    return F.struct(*[(literal(v) if isinstance(v, Mapping) else F.lit(v)).alias(k) for k, v in block.items()])
