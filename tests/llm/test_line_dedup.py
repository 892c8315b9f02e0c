"""Lines against a plain account in Python."""

import random

from conftest_llm import MESSY, texts_of

from assaybook.llm import line_dedup

SPACES = " \t\n\x0b\x0c\r"
LAST = 1 << 62


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def by_hand(rows, min_docs=2, min_chars=10):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(LAST if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(holders.get(key(x), ())) < min_docs or min(holders[key(x)]) == (LAST if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def got(df, **settings):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.drop_repeated_lines(df, **settings).collect()), key=str)


def test_messy_rows(messy):
    assert got(messy) == by_hand(texts_of())


def test_thresholds(make):
    random.seed(1)
    pool = [f"Line {i} with some words" for i in range(12)] + ["short", "", "  LINE 3 with some words\r"]
    rows = [(i % 40, "\n".join(random.choice(pool) for _ in range(random.randint(0, 8)))) for i in range(60)]
    for settings in ({}, {"min_docs": 3}, {"min_docs": 5, "min_chars": 3}):
        assert got(make(rows), **settings) == by_hand(rows, **settings)


def test_own_columns_come_through(messy):
    assert sorted(map(str, messy.collect())) == sorted(str(r["row"]) for r in line_dedup.drop_repeated_lines(messy).collect())
    staged = line_dedup.line_dedup_stage(messy)
    assert staged.schema == messy.schema and staged.count() == len(MESSY)
    assert all(r["n_chars"] == len(r["text"]) and r["kept"] == "x" for r in staged.collect())


def test_no_rows(nothing):
    assert line_dedup.drop_repeated_lines(nothing).isEmpty()
    assert line_dedup.line_dedup_stage(nothing).schema == nothing.schema


def test_no_python_in_the_plan(messy):
    plan = line_dedup.drop_repeated_lines(messy)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
