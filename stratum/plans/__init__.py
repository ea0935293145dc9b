"""Pipelines: steps, run log, alerts, reports."""
