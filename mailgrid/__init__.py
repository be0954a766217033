"""Capacity planning for registered mail, written as Spark DataFrame functions.

``sources`` read and write tables, ``functions`` are column expressions, ``operators`` are
reusable DataFrame steps, ``plans`` are the domain pipelines and views built from them.
"""
