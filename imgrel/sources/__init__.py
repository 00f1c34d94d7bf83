"""Inputs: derived views over the tables, and files of images."""
