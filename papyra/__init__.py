"""Text and table analytics as plain PySpark operators."""
