"""Operators: rules, reconciliation, audits, statistics, sampling, effects, models."""
