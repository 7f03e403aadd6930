"""Manifest files, catalog loads, content inventories and report files."""
