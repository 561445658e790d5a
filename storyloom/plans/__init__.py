"""Named queries over the driver's tables, each beside its SQL oracle."""

from storyloom.plans import domain, intake, library, reports, texts, views  # noqa: F401
from storyloom.plans.registry import QUERIES, SQL  # noqa: F401
