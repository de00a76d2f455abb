"""Operators over movements, traces, labels and cases."""
