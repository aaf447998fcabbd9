"""Operators of a training-data pipeline over corpora. Nothing else in the library imports this subpackage."""
