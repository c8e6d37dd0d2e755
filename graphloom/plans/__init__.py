"""Whole-query plans: stores, passes, reviews and evaluation."""
