"""Announcement and page-corpus analytics on PySpark DataFrames."""
