"""Packet sources: tables and capture files."""
