"""Adapters that turn tables and documents into a graph."""
