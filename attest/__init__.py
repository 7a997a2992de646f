"""attest: measuring whether generated answers are correct and supported, on Spark."""
