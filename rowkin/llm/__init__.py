"""Operators for training-data pipelines: matching, spelling, text repair, counting, sampling, encoding, leakage and abuse.

Nothing outside this package imports it.
"""
