"""Versioned, ordered key-value data as ordinary Spark DataFrames.

model      schema of mutations and key encoding
operators  pure DataFrame -> DataFrame operators: versions, pruning, compaction, level policy
functions  column functions on keys, and the few helpers that planning needs on the driver
sources    the store on disk: runs, log, manifest
streaming  micro-batches of mutations into a store
plans      the registered queries and their SQL
"""
