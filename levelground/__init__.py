"""Point-cloud landing-zone analytics on PySpark."""
