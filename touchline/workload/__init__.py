"""Queries registered for the driver; importing a module registers its queries."""
from touchline.workload import portfolio, projection, linking, grouping, ordering, timing, fitting, matches, landing, composed, streams, jobs  # noqa: F401
from touchline.workload.registry import COVERS, ORACLE, QUERIES  # noqa: F401
