"""Element ids: a prefix and 24 hexadecimal digits of a digest over the components, each with its length before it."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ids of each kind begin with.
PREFIXES = {
    "workbook": "wb", "document": "doc", "presentation": "prs", "pdf": "pdf", "sheet": "sh", "cell": "c", "named_range": "nr", "style": "st", "comment": "cm", "chart": "ch", "picture": "pic",
    "paragraph": "p", "slide": "sl", "shape": "shp", "table": "tb", "table_cell": "tc", "page": "pg", "field": "fld",
}
SCHEMA_VERSION = 1


def element_id(kind: str, *components: Column) -> Column:
    """Components cannot run into each other: ("ab", "c") and ("a", "bc") differ. Null counts as empty."""
    parts = [F.lit(f"{kind}/{SCHEMA_VERSION}")]
    for c in components:
        value = F.coalesce(c.cast("string"), F.lit(""))
        parts += [F.concat(F.lit("/"), F.octet_length(value).cast("string"), F.lit(":"), value)]
    return F.concat(F.lit(PREFIXES[kind] + "_"), F.substring(F.sha2(F.concat(*parts), 256), 1, 24))


def element_id_of(kind: str, *components: object) -> str:
    """The same id for values at hand."""
    text = f"{kind}/{SCHEMA_VERSION}" + "".join(f"/{len(v.encode())}:{v}" for v in ("" if c is None else str(c) for c in components))
    return f"{PREFIXES[kind]}_{hashlib.sha256(text.encode()).hexdigest()[:24]}"
