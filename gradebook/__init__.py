"""gradebook: model-evaluation analytics as Spark DataFrame jobs.

Sub-packages
------------
functions  Column -> Column helpers (verdict/letter extraction, templates, tokens, text)
operators  DataFrame -> DataFrame operators (matches, games, boards, prompts, ...)
sources    readers and writers for the judgment/answer/question/MC file layouts
plans      derived fixture views, the query registry and DuckDB oracle SQL
streaming  incremental leaderboard over an append-only judgment log
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value for Python workers.

    Model-call operators and pandas UDFs run library code inside Python workers.
    When the package is not installed on the workers (a driver started from
    another folder, or no ``--py-files``), by-value pickling still ships it.
    """
    import sys

    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: rely on installed package / --py-files
        pass


_ship_by_value()
