"""Readers, stored tables, row numbers and the dataset catalog."""
