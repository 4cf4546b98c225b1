"""Texts that every operator must take."""

#: Nulls, empty and blank texts, repeated rows, marks of other scripts, and a very long text.
ODD = [None, "", " \n\t ", "one", "one", "A b C d e", "a B c D e", "x" * 70_000, "word " * 30_000, "ſK é 中文 😀 ▁ <|endoftext|>\r\nend", "a  b\n\n\nc"]
