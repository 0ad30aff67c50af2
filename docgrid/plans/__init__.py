"""Whole plans: synthetic layouts from texts, and conversion of files."""
