"""All queries of the library and their SQL."""

from lexmill.plans import catalog, given  # noqa: F401  registers them
from lexmill.plans.common import ORACLES, QUERIES  # noqa: F401
