"""quarrymill: catalog cleaning, reporting and analytics as Spark DataFrame jobs."""
