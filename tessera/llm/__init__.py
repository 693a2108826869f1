"""Operations for large-scale training-data pipelines.

Nothing else in the library imports this package.  Each module holds one
operator with a general interface; ``queries`` binds them to the tables.
"""
