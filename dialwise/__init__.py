"""Which of a person's phone numbers to message: dispatch-log analytics as Spark jobs."""
