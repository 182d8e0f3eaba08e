"""Streams: pages as they finish, told of in order."""
