"""Rows of edge cases that the tests of all operators share."""

SF_SMALL = "/root/testdata/sf0.001"

LONG = "lorem ipsum dolor sit amet " * 20000
EDGE = [(None, "a row without an id"), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, LONG), (6, LONG),
        (7, "twice the same row and id"), (7, "twice the same row and id"), (8, "\U0001F600 ünï cödé ▁ \x00\x01\x02 end"), (9, "?!?")]
