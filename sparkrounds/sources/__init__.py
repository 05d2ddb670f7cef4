"""Readers, writers and deterministic table generators."""
