"""STR-8: units of measure in one vocabulary."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from .names import strip

# Accepted spellings of each unit.
SPELLINGS = {
    "UN": ["un", "und", "uds", "u", "unid", "unidade"],
    "KG": ["kg", "kgs", "kilogramo", "kilogramos", "kilo"],
    "G": ["gr", "grs", "g", "gramo", "gramos", "gram"],
    "L": ["lt", "lts", "l", "litro", "litros", "litre"],
    "ML": ["ml", "mililitro"],
    "CAIXA": ["cx", "caixa", "caja", "box"],
    "PACK": ["pack", "pck", "paquete"],
}


def normalize_unit(c: Column) -> Column:
    """Canonical unit of a raw spelling; null for unknown or blank ones."""
    pairs = [(s, unit) for unit, words in SPELLINGS.items() for s in words]
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)])
    return F.try_element_at(table, F.lower(strip(c)))
