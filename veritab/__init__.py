"""Veritab: checked, traceable records as lazy Spark plans."""
