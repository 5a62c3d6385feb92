"""tessera: sentence-polarity analytics and corpus operators on PySpark."""
