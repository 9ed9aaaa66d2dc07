"""Sources and sinks: source listings, configuration, key-value and artifact stores, reports."""
