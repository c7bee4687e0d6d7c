"""Stateful operators, batch and stream."""
