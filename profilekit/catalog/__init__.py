"""All registered queries; importing the modules fills the registry."""

from profilekit.catalog import features, forests, missingness, outliers, tables  # noqa: F401
from profilekit.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
