"""Transcript evaluation and experiment analytics on Spark DataFrames.

Sub-packages:

``functions``  Column expressions (text normalising, edit counts, JSON, names, audio arrays)
``sources``    schemas, readers and sinks
``operators``  DataFrame -> DataFrame building blocks
``plans``      the building blocks put together into whole stages, and the query catalogue
``streaming``  incremental scoring of response files
"""
