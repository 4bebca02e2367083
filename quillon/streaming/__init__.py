"""Structured Streaming: an index that follows a folder of changed files (an extension beside the engine's batch operators)."""
