"""How the work is laid out over the cluster, and the composed jobs."""
