"""Yearly files, report files and the test view over the star schema."""
