"""GeoJSON, survey and configuration sources and sinks."""
