"""Streaming: live changes of turns."""
