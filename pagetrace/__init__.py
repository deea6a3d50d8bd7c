"""pagetrace: text-evidence analytics over scanned pages, written as Spark DataFrame operators."""
