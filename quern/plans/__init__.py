"""The engine's own queries, with the SQL that gives the same rows elsewhere."""

from . import custom, relational, scalar, timed, vectors

QUERIES = relational.QUERIES | scalar.QUERIES | timed.QUERIES | custom.QUERIES | vectors.QUERIES
SQL = relational.SQL | scalar.SQL | timed.SQL | custom.SQL | vectors.SQL
