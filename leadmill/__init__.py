"""Business-contact extraction, outreach analytics and corpus preparation as Spark jobs."""
