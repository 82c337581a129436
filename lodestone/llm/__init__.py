"""Operations of a training-data pipeline over the ``documents`` and ``embeddings`` tables.

Each module holds one operator with its own general interface; ``queries`` binds
them to fixed parameters and result columns.
"""
