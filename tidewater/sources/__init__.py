"""Sources and sinks: readers for landed files, JDBC, nested flattening,
table writers and the load audit, plus adapters from the driver tables."""
