"""Operators of training-data pipelines; nothing else in docaudit imports this subpackage."""
