"""Operators for training-data pipelines; each module holds one operator, its query and, where SQL can say it, the SQL."""
