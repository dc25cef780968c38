"""All registered queries of the reference's own operators."""

from spanlake.plans import capsule, evaluate, extra, files, lookup, measure, pack, retrieve, scan, telemetry  # noqa: F401
from spanlake.plans.registry import ORACLE, QUERIES  # noqa: F401
