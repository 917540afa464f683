"""Queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = ["lookalikes", "bpe", "packing", "proportional", "survivors", "formatting_copies", "overlap", "abuse", "listings", "masks"]
QUERIES, ORACLES = {}, {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
