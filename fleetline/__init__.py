"""Transit performance analytics and corpus operators as Spark jobs."""
