"""Typed statement analytics on Spark: sheets of measures, an expression algebra over them, and reports."""
