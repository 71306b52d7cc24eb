"""The catalogue of queries, each with the SQL that gives the same rows where SQL can."""
