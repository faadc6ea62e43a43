"""wardgrid: Spark DataFrame operators for intensive-care time series."""
