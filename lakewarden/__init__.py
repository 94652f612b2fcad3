"""lakewarden: data-governance analytics and corpus preparation on Spark."""
