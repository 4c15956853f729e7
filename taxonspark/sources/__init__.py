"""Sources: sheet loaders, workbook reader, test fixtures derived from the driver tables."""
