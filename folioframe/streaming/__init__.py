"""Structured Streaming forms of the polling and stateful operators."""
