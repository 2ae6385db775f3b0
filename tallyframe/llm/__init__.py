"""Training-data operators: thirteen corpus operators and their registered queries.

Nothing else in the library imports this subpackage. Each module holds one
operator with its general interface; ``queries`` registers the thin query of
each operator and, where SQL can state the result, its DuckDB text.
"""
