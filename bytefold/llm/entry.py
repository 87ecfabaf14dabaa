"""Queries of the subpackage, for the driver's entry module."""

from __future__ import annotations

import importlib

MODULES = ("p1_license", "p2_secrets", "p3_frequent", "p4_neardup", "p5_handwritten", "p6_natural", "p7_lookalike", "p8_encode", "p9_pack", "p10_spam")
QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
