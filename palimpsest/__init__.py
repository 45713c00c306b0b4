"""Palimpsest: a PySpark-native engine for versioned data.

Revision graphs, keyed indices, content maps, tree snapshots and line histories
are plain DataFrames; every operator is ``f(DataFrame, ...) -> DataFrame``.
"""
