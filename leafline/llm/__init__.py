"""Training-data operators over tables of documents.

Nothing else in the library imports this subpackage, so it can be removed as a whole; of
the library it uses the store of intermediate tables.
"""
