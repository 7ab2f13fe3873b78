"""Bibliographic, textual and co-authorship analytics as Spark DataFrame plans."""
