"""refsieve: a PySpark toolkit for cleaning, comparing and preparing bibliographic records and texts."""
