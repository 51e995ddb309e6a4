"""Operations of a training-data pipeline: tokenising, formatting, filtering, de-duplication, packing.

Nothing outside this subpackage (but ``corpus_pipeline.py`` and the guard in ``__spark_entry__.py``) imports it.
"""
