"""Containers and readers: bytes in, the document model out. Called inside one Arrow function per file."""
