"""The registered queries and their SQL."""

from quarry.catalog import corpus, extras, guides, more, procs, programs, rest, steps  # noqa: F401
from quarry.catalog.base import ORACLES, QUERIES  # noqa: F401
