"""Operators for preparing language-model training data as Spark jobs.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames and reads only the columns it names; operators that hand rows on
carry them in a struct, so that other columns may have any name.  Each states
its result for nulls, empty and very long texts, ties and repeated rows in its
docstring.
"""
