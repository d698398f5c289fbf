"""Operators for preparing training data: dedup, decontamination, filtering, mixing, sharding.

Nothing outside this subpackage imports it.
"""
