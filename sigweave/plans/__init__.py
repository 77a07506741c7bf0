"""Whole studies: operators composed into one declarative plan each."""
