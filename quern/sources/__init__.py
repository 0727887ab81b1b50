"""Readers and writers of the tables that questions, answers and documents come in."""
