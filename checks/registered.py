"""Importing this module registers every query."""

from checks import detectchecks, gridchecks, matchchecks, plans, scalars, statistics, streams  # noqa: F401
