"""repocensus: technology inventory of source-code repositories on Spark.

Tables of files, manifests, vulnerability reports and commit history go in; one
flat ``findings`` table comes out, ready for SQL.  Everything is DataFrame work:
extractors are column expressions evaluated in the scan, so a whole inventory is
one pass over the file table without a shuffle.
"""

__version__ = "0.1.0"
