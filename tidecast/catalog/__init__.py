"""Registered queries. Importing this package fills the registry."""

from tidecast.catalog import aggregates, filters, joined, models, panels, quality, scalars, storage, stream  # noqa: F401
from tidecast.catalog.registry import ORACLES, QUERIES  # noqa: F401
