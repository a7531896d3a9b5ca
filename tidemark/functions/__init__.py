"""Aggregate functions as Column builders."""
