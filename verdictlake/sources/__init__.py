"""Readers and writers of records, reports and fitted parameters."""
