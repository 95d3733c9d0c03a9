"""Plan-geometry analytics and corpus operators on PySpark."""
