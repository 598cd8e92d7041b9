"""Readers and writers: media folders, catalogs, templates, exports."""
