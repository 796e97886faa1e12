"""Every registered reference query with its SQL counterpart.

A plan module lists ``QUERIES`` (name -> callable(spark, sf_dir)) and
``ORACLES`` (name -> SQL on the same tables); this module joins them.
"""

from __future__ import annotations

from . import dynamics, signals, structure

MODULES = (signals, structure, dynamics)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}
