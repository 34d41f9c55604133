"""Foliant: document analytics and retrieval as PySpark DataFrame programs."""
