"""Rows that every operator must stand."""

DOCS = "doc_id long, text string"

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one two three four five six seven eight nine ten eleven"),
    (5, "one two three four five six seven eight nine ten eleven"), (None, "no id here"), (None, None), (6, "ÀÉ ß naïve 日本語 — dash"),
    (7, LONG), (8, "a\nb\na\nb\n\n  \na"), (9, "x" * 50_000), (10, "don't it's <|endoftext|> 'tis\r\n\x0b\x0c end"),
]
