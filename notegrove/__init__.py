"""A full-text search engine on DataFrames: ingest, query language, ranking, excerpts."""
