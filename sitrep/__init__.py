"""sitrep: social posts to disaster events, as Spark DataFrame operators and jobs."""
