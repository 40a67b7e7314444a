"""Operations of a training-data pipeline over a corpus of documents.

Each module holds one operator with its own general interface; ``queries``
derives from them the digest columns that the registered queries return.
Nothing outside this subpackage imports it.
"""
