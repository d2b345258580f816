"""Registered queries: name -> callable(spark, sf_dir), and name -> DuckDB SQL."""

from __future__ import annotations

from tarnwatch.plans import evaluations, grids, lakes_and_corridors, landed_records, models_and_matches, places_and_samples, shapes, weather_and_risk

_MODULES = (weather_and_risk, evaluations, grids, places_and_samples, models_and_matches, lakes_and_corridors, landed_records, shapes)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
