"""Object label spellings."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Logged spelling -> canonical label.
CANONICAL = {
    "cleanser": "cleanser",
    "bleach_cleanser": "cleanser",
    "coffee_can": "coffee_can",
    "master_chef_can": "coffee_can",
    "mug": "mug",
    "meat_can": "meat_can",
    "potted_meat_can": "meat_can",
    "tuna_can": "meat_can",
    "rubik": "rubik",
    "rubiks_cube": "rubik",
    "gelatin_box": "gelatin_box",
    "mustard": "mustard_bottle",
    "mustard_bottle": "mustard_bottle",
}
# Canonical label -> catalogue label.
CATALOGUE = {
    "cleanser": "bleach_cleanser",
    "coffee_can": "master_chef_can",
    "mug": "mug",
    "meat_can": "potted_meat_can",
    "gelatin_box": "gelatin_box",
    "mustard_bottle": "mustard_bottle",
    "rubik": "rubik",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(entries, key), key)


def canonical_label(label: Column) -> Column:
    """Trimmed, lower-cased, aliases resolved; unknown labels pass through."""
    return _lookup(CANONICAL, F.lower(F.trim(F.coalesce(label, F.lit("")))))


def catalogue_label(label: Column) -> Column:
    return _lookup(CATALOGUE, label)
