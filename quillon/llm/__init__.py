"""Training-data operators: encoding, formatting, sharding, mixing, deduplication, quality and scoring.

Every operator takes and returns DataFrames and works on whole tables. The queries of
``registry`` are thin: they read a table, call the operator and derive the columns of a contract.
"""
