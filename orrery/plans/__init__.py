"""Queries: the operators bound to tables, each with its SQL for comparison."""
