"""tidewatch: log detection as Spark jobs."""
