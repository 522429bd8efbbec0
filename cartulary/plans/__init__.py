"""Composite dataflows: capture, discovery, detail, drift, reports."""
