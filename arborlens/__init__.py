"""Repository analytics and training-data operators as PySpark DataFrame plans."""
