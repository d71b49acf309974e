"""Order-dependent state machines as NumPy kernels; none of these modules imports Spark."""
