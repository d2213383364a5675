"""All registered queries."""

from meterfold.plans import q_analytics, q_basic, q_streams  # noqa: F401
from meterfold.plans.oracle import ORACLES, QUERIES  # noqa: F401
