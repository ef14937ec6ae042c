"""Keys of derived results: what was derived, from which bytes, by which version of what, set up how."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recipe_key(source_hash: Column, processor_id: Column, processor_version: Column, config_hash: Column, input_hashes: Column) -> Column:
    """The key of a derivation: SHA-256 of its recipe as JSON. Another value of any field, or another order of inputs, gives another key; nulls count as empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    inputs = F.coalesce(F.transform(input_hashes, text), F.array().cast("array<string>"))
    return F.sha2(F.to_json(F.struct(text(source_hash).alias("source_hash"), text(processor_id).alias("processor_id"), text(processor_version).alias("processor_version"), text(config_hash).alias("config_hash"), inputs.alias("input_hashes"))), 256)
