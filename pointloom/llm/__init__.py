"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it; removing it leaves the rest of the library whole.
"""
