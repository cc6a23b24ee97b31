"""Training-data operators: quality, tokens, packing, search, filtering and duplicate removal.

Nothing else in the library imports this subpackage.  ``queries.py`` holds the registered
``opN_*`` queries; every operator module can be used on its own.
"""
