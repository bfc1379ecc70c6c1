"""Odd documents: nulls, empty and long texts, ties and repeated rows."""

import random

LONG = " ".join(random.Random(5).choices("alpha beta gamma delta epsilon zeta eta theta iota kappa".split(), k=6000))
PASSAGE = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, None, None, "s", 1), (2, "", "en", None, 2), (3, " \n\t ", "en", "s", 3), (4, "One", "en", "s", 4), (5, "one", "en", "s", 4), (6, "a b c", "xx", "s", 5), (7, LONG, "en", "s", 6), (8, LONG, "en", "s", 6),
    (9, f"start {PASSAGE} end of nine", "en", "s", 7), (10, f"other {PASSAGE} tail", "en", "s", 8), (10, f"other {PASSAGE} tail", "en", "s", 8), (11, "x " * 40, "fr", "s", 9), (12, "x " * 40 + "y", "fr", "s", 9), (None, f"no id {PASSAGE}", "de", "s", 10),
    (13, "Released under the MIT License. Licensed under the Apache License, Version 2.0. CC-BY", "en", "s", 11), (14, "é" * 300 + " <|endoftext|> it's 漢字 😀", "de", "s", 12),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ("n", "rep", "row", "grp", "label", "shard", "slot", "items", "words", "piece", "gram", "bucket", "k1", "length", "score", "kept", "component_id", "starts", "n_words", "rank", "block", "ids", "_number", "_block", "_ends", "_rank", "_again", "_strip", "_corpus_row", "_text", "_k", "_starts", "_n", "dotted.name", "a`tick")
