"""Bindings of the driver tables to the archive's data model, and the query catalog."""
