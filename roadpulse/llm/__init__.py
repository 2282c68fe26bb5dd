"""Operators of a training-data pipeline (URL filter, near and exact dedup, chat
formatting, mixing, sharding, quality, decontamination, repeated passages,
language ID). Nothing outside this subpackage imports it."""
