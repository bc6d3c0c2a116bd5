"""Every registered query of the scene engine with its SQL twin."""

from __future__ import annotations

from scenova.plans import aggregates, annotations, audits, detection, files, generators, geometry, joins, points, pooling, ranking, records, samples, scoring, spans, texts  # noqa: F401
from scenova.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
