"""Back-office analytics for a small food business, written as Spark jobs."""
