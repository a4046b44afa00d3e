"""Operators for preparing training text at cluster scale.

Nothing outside this subpackage imports it; the query registry adds it only where it can be imported.
"""
