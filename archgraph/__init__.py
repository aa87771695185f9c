"""archgraph: typed architecture graphs over many repositories, as Spark jobs."""
