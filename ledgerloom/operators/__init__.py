"""DataFrame operators over OCR lines, rows, records and links."""
