"""Operators of a training-data pipeline: filtering, deduplication, scanning, mixing and sharding.

Nothing outside this subpackage imports it; ``queries`` and ``oracle_sql`` in
``quern.llm.queries`` are what the driver registers.
"""
