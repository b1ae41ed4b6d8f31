"""Readers, writers and graph views over tables."""
