"""Whole workflows and reports put together from the operators."""
