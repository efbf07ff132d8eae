"""Operators for preparing training data: packing, scoring, de-duplication, sharding, archives.

Nothing else in the library imports this subpackage.
"""
