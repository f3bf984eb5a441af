"""Concrete plans: fixture mappings onto the driver tables and the registry of
named queries (``trialframe.plans.registry``)."""
