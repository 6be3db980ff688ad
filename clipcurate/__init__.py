"""Curation of large clip libraries as Spark jobs: signals, gates, selection, measurement."""
