"""Operators of a training-data pipeline: archives, extraction, filters, de-duplication, mixing and packing.

Nothing outside this subpackage imports it except the driver entry, which adds
its queries only where the subpackage is present.
"""
