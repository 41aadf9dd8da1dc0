"""What each layer computes, composed from the operators, and the queries over the driver tables."""
