"""curatrix: dataset curation and analysis as DataFrame transforms."""
