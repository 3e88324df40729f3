"""Operators of a training-data pipeline: filtering, deduplication, decontamination and mixing.

Nothing outside this subpackage imports it. ``queries`` lists its registered queries.
"""
