"""Importing this module fills the register."""

from verification import joins_aggregates, pipelines, posterior_lookup, soil_physics, sources_shape  # noqa: F401
