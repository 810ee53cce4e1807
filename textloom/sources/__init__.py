"""Spreadsheets as a Spark data source, and readers with checks."""
