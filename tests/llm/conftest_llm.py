"""Documents with every trouble the operators must take."""

# columns of the user's own, with names that the operators use inside
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, whole string, doc long, k1 string, "
          "t1 long, d long, pos string, kept string, batch long, family string, size string, copies string, verdict string")


def document(doc_id, text, source="s", **own):
    row = dict(doc_id=doc_id, text=text, lang="en", source=source, n_chars=None if text is None else len(text), row="r", whole="w",
               doc=-1, k1="k", t1=-2, d=-3, pos="p", kept="x", batch=-4, family="f", size="z", copies="c", verdict="v")
    return tuple({**row, **own}.values())


PASSAGE = "the quick brown fox jumps over the lazy dog while seven other animals look on from the hill"
MESSY = [
    document(5, "alpha beta gamma delta\n" + PASSAGE + "\nshort\nend of five"),
    document(3, "first line of three\n" + PASSAGE + "\nshort\nend of three is here"),
    document(3, "first line of three\n" + PASSAGE + "\nshort\nend of three is here"),              # the same row again
    document(3, "another text under the same id\n" + PASSAGE),
    document(None, "a text without an id\n" + PASSAGE, source=None),
    document(None, None, source=None),
    document(7, None), document(8, ""), document(9, " \t\n "), document(10, "one"), document(11, "ünï çødé 　 \U0001F600 ▁x"),
    document(12, "  " + PASSAGE.upper() + "  \n\n" + PASSAGE + "\n" + PASSAGE, source="t"),
    document(13, "word " * 4000 + PASSAGE, source="t"), document(14, "x" * 30000, source="u"), document(15, "x" * 30000, source="u"),
    document(16, "mail a.b@c.de or +49 30 1234567, 10.0.0.1 and 4111 1111 1111 1111 please", source="u"),
    document(17, "\n".join(f"line number {i} of a long list of lines" for i in range(300)), lang=None, source=""),
]


def texts_of(rows=None):
    return [(r[0], r[1] or "") for r in (MESSY if rows is None else rows)]
