"""Column functions over whole tables; none of them needs Python per row."""
