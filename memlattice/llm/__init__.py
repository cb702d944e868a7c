"""Operators for training-data pipelines over text corpora.

Nothing outside this subpackage imports it.  Each module keeps one operator with
a general DataFrame interface; ``queries`` derives the registered query results
from them and ``oracle`` holds the SQL they are compared with.
"""
