"""Training-data operators: Spark jobs over document, page, benchmark and embedding tables.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; the registered queries live in :mod:`tradelens.llm.queries`.
"""
