"""Operators for preparing training data. Nothing else in loomtrace imports this subpackage."""
