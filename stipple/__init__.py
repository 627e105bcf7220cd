"""Multiscale point-pattern analytics as DataFrame plans."""
