"""Operators for preparing large text corpora (language ID, dedup, sharding, ...).

Nothing else in the library imports this subpackage. ``registry.QUERIES`` and
``registry.ORACLES`` hold the queries the driver entry adds.
"""
