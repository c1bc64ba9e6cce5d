"""Call-stack analytics on Spark: sampled stacks of parallel programs as DataFrames."""

__version__ = "0.1.0"


def version() -> str:
    return __version__
