"""Column expressions: text, numbers, dates, money and label maps. All native, no Python per row."""
