"""ticketlab: support-ticket analytics and data-quality checks on Spark.

Raw tickets -> :func:`operators.clean.clean_tickets` -> :func:`operators.filters.filter_tickets`
-> result tables (``operators.metrics``, ``trends``, ``durations``, ``words``);
raw tickets -> :func:`operators.clean.quality_input` -> ``operators.profile``,
``operators.similar``, ``operators.issues``.
"""

from .operators.clean import CleanConfig, clean_tickets, quality_input  # noqa: F401
from .operators.filters import TicketFilter, filter_tickets  # noqa: F401
from .session import get_spark, materialize  # noqa: F401
