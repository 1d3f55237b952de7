"""Operators for large text corpora: near duplicates, quality, personal data, tokens, archives, mixing.

Every operator takes DataFrames and returns DataFrames. Inputs may hold further columns under any name: an
operator reads the columns that it names and leaves the others alone. Rows whose id (``doc_id``, ``vec_id``,
``page_id``) is null are no documents and are left out, unless a docstring says otherwise; null texts count as
empty. Intermediate tables go to ``spark.checkpoint.dir`` (see :mod:`tessera.llm.common`).
"""
