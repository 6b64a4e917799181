"""tidemill: batch and streaming analytics written with the PySpark DataFrame API."""
