"""Readers, vendor mappings and price scans."""
