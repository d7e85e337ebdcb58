"""Reports, report groups and their outputs, and the registered query catalog."""
