"""Flight telemetry, point-cloud and corpus operators as lazily evaluated Spark plans."""
