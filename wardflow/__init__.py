"""wardflow: hospital patient-flow analytics as Spark DataFrame pipelines."""
