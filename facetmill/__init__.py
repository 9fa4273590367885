"""Spark jobs for labelled feature tables: preparation, classifiers, clustering and model selection."""
