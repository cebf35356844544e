"""gridwatch: gridded spatio-temporal analytics, and text-corpus operators, as PySpark DataFrame jobs."""
