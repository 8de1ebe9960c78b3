"""Point-cloud anomaly analytics expressed as Spark DataFrame jobs."""
