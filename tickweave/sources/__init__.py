"""Price stores, data sources and generators."""
