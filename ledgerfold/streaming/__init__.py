"""Mutation logs that are still being written."""
