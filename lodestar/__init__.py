"""lodestar: a PySpark-native signal-analytics engine.

Everything returns lazy DataFrames; see the sub-packages ``sources``,
``functions``, ``operators``, ``plans`` and ``streaming``.
"""
