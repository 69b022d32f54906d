"""Queries over the driver tables, each with its SQL check where one exists."""

from . import audit, classification, dedup, ingest, matching, recommend, serving, sources, text  # noqa: F401
from .base import ORACLE, QUERIES  # noqa: F401
