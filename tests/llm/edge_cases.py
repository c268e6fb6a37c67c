"""Documents that every operator must handle: nulls, empty, blank, very long, unbroken, repeated, without an id."""

EDGE = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "one"), (5, "a b"), (6, "a b"), (7, "word " * 60_000), (8, "x" * 200_000),
    (9, "Grüße 🌲 例え テスト é \u0000 end"), (None, "no id here"), (None, None), (10, "same same same"), (10, "same same same"),
]
