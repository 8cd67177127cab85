"""Packet sources, flow files and the flow store."""
