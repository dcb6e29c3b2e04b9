"""The registered queries of the sanitiser and the SQL that gives the same rows."""

from .pages import ORACLES as PAGE_ORACLES
from .pages import QUERIES as PAGE_QUERIES
from .tables import ORACLES as TABLE_ORACLES
from .tables import QUERIES as TABLE_QUERIES

QUERIES = PAGE_QUERIES | TABLE_QUERIES
ORACLES = PAGE_ORACLES | TABLE_ORACLES
