"""Sequential detectors as plain state machines: no Spark in here, so batch and streaming run the same objects."""
