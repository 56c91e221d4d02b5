"""loadlark: athlete-load and competition analytics as plain Spark DataFrame jobs."""
