"""All registered queries. Importing a module registers its queries."""

from tabulon.plans.queries import access, cleaning, invariants, models, plots, profiling, reports, text  # noqa: F401
from tabulon.plans.queries.base import ORACLES, QUERIES, Tables  # noqa: F401
