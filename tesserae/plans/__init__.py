"""Registered queries."""

from tesserae.plans import generated  # noqa: F401
