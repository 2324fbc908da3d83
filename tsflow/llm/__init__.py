"""Operators of a training-data pipeline over ``documents`` and ``pages``.

Nothing else in the library imports this subpackage.  Every operator takes a DataFrame, names
its id and text columns as parameters, reads only those two columns (so extra columns of any
name cannot clash), and returns the id with its own result columns.  Each row is a document;
a null text counts as the empty text unless a docstring says otherwise.
"""
