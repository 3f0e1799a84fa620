"""Quarryflow: an analytics engine and corpus toolkit written on PySpark's DataFrame API."""
