"""Event-table analytics on PySpark."""
