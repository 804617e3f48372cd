"""Folioscope: document-layout analytics and training-data preparation on PySpark."""
