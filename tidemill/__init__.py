"""tidemill: causal, gap-aware time-series and corpus processing on Apache Spark."""

__version__ = "0.1.0"
