"""Sources: directories of files, and pages of PDF files."""
