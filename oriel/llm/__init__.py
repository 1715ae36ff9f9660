"""Training-data operators: deduplication, packing, rules, mixing, WARC, HTML, URLs, vectors.

Nothing else in the library imports this subpackage.  ``queries()`` and
``oracle_sql()`` are merged by the entry module when the subpackage is present.
"""

from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
