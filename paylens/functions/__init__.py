"""Column-expression library shared by batch queries and streaming sinks."""
