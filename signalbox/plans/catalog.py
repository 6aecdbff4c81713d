"""All registered queries."""

from signalbox.plans import data_queries, file_queries, grading_queries, message_queries, router_queries  # noqa: F401
from signalbox.plans.registry import QUERIES, SQL  # noqa: F401
