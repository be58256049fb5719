"""Operators for training-data pipelines (HTML, tokens, quality, duplicates, PII, shards).

Nothing else in the package imports this subpackage.  ``queries`` holds the
registered queries; every operator module keeps its own general interface.
"""
