"""Soil-sensor analytics as Spark DataFrame functions and Column expressions."""
