"""Streaming: nothing of its own.

The library's jobs are batch jobs. Its stateless expressions
(:mod:`loomgrid.functions.text`, the rules of :mod:`loomgrid.operators.classify`,
joins with dimension tables) apply to streaming DataFrames as they are.
"""
