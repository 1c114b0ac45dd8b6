"""Site-feasibility analytics and corpus preparation as Spark DataFrame transforms."""
