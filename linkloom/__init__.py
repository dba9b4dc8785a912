"""Link-graph analytics on Spark."""
