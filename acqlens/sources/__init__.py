"""Sources and sinks: typed CSV / Parquet model I/O and the driver-table adapter."""
