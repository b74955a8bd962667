"""Operations of a training-data pipeline: search, scoring, formatting,
packing, language ID, near and exact duplicates, secrets and mixing.

Nothing else in the library imports this subpackage; ``queries.py`` holds
the registered queries and their SQL.
"""
