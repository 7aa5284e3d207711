"""Registered queries. Importing this package fills the registry."""

from tideline.catalog.registry import ORACLES, QUERIES  # noqa: F401
from tideline.catalog import guards, pricing, scalars, selection, sequences, sources, statistics, survival  # noqa: F401
