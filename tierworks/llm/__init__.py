"""Operators for training-data pipelines over tables of whole texts.

Every operator takes a DataFrame and the names of its id and text columns, reads no other column, and
returns a new DataFrame; ``queries`` binds them to the given tables.
"""
