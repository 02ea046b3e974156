"""Agent memory on Spark: typed memories, ranked recall, snapshots and a result cache as DataFrame plans."""
