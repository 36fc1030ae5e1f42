"""Training-data operators: DataFrame -> DataFrame, for corpora of any size.

Each module holds one operator with its own general interface; ``queries.py`` holds the
thin registered queries over the driver's tables.  Nothing else in the library imports
this subpackage.
"""
