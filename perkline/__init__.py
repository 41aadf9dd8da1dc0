"""Card-loyalty analytics on Spark: raw feeds to validated facts, a versioned card dimension, rewards and marts."""
