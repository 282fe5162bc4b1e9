"""Readers for the raw CSV files and readers/writers for prepared tables."""
