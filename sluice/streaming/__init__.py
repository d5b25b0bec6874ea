"""Structured Streaming: producing, consuming, and keyed state."""
