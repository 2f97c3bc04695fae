"""loomtext: corpus building and auditing as Spark DataFrame operators."""
