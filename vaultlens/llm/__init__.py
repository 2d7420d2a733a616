"""Operators that prepare training text: one module for each, DataFrame in and out.

Every operator reads all rows and whole texts. Columns it does not name are
ignored, or carried along where it returns the documents themselves.
"""
