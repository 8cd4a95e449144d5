"""The record system's tables, functions and views in a catalog, for users of SQL."""
