"""Change feeds as Structured Streaming jobs, and their batch equivalents."""
