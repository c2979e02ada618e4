"""Operators that prepare text for training, and the queries that apply them to whole tables.

Nothing outside this subpackage imports it, apart from the guarded import of the driver contract.
"""
