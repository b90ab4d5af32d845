"""Instruction-data building and answer scoring on PySpark."""
