"""Key forms and the known split labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Split labels in key form, and the group each belongs to.
SPLIT_GROUP = {
    "train": "train",
    "val_overlapped": "val",
    "val_outside": "val",
    "test_overlapped": "test",
    "test_outside": "test",
}
OUTSIDE_SPLITS = ("val_outside", "test_outside")


def key_form(col: Column | str) -> Column:
    """Lower case, every run outside a-z0-9 one underscore, none at either end; blank gives null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_|_$", ""), F.lit(""))


def known_split(col: Column | str) -> Column:
    """The label in key form where it is a known split, else null."""
    key = key_form(col)
    return F.when(key.isin(*SPLIT_GROUP), key)


def split_group(key: Column) -> Column:
    """train, val or test of a label in key form; null for others."""
    pairs = [F.lit(x) for kv in SPLIT_GROUP.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def valid_phenotype(col: Column | str) -> Column:
    """The phenotype where it is 0 or 1, else null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isin(0, 1), c.cast("int"))
