"""Java sources to dataflow graphs."""
