"""Operators of a training-data pipeline, each a DataFrame -> DataFrame function.

``queries.JOBS`` registers one query per operator; ``queries.SQL`` holds the DuckDB
statements of those that SQL can express. Nothing outside this folder (and
``corpus_pipeline.py``) imports from here.
"""
