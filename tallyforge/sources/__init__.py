"""Reading and writing: snapshots, paged HTTP, extraction windows, versioned tables."""
