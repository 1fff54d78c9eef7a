"""Readers: EXPRESS schemas into catalogs, exchange files into statements."""
