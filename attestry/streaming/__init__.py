"""Assets and evidence over streams of files."""
