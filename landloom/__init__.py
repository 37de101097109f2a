"""landloom: versioned planning data as Spark jobs."""
