"""Workloads put together from the operators."""
