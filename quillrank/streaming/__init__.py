"""No operator of this library works on streams: every input is a finite table that a manifest or content hash pins.

Rows that arrive over time are a new version of the evidence table; ``operators.evidence.version_membership`` compares
versions, and ``operators.temporal`` cuts them by date.
"""
