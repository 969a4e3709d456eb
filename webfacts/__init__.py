"""webfacts: analytics over captured web data, written as PySpark DataFrame transforms."""
