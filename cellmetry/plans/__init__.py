"""Registered queries with their check SQL, and the whole pipeline plan."""

from cellmetry.plans import views  # noqa: F401  the shared check views come first
