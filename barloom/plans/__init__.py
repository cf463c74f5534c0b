"""Every registered query. Importing this package fills CATALOG."""

from barloom.plans.registry import CATALOG  # noqa: F401
from barloom.plans import calendar_outcomes, cross_source, crosssection, engine, events, factory, flagship, joins, labels, legacy, market, models, sequential, sources, stability, stats, streams, windows  # noqa: F401
