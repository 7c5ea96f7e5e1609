"""All registered queries; importing the modules fills the registry."""

from catalog import blend, corr, flows, metrics, model, profile, scalar, tables, window  # noqa: F401
from catalog.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
