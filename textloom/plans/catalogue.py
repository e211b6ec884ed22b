"""All queries of the library by name, and the SQL that the exact ones are held against."""

from . import catalogue_factors, catalogue_measures, catalogue_models, catalogue_pairs, catalogue_readers, catalogue_search, catalogue_sources, catalogue_stats, catalogue_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
