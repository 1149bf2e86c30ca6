"""Readers and writers of the survey's file formats."""
