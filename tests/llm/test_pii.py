"""Spans against regular expressions in Python, and terms that give an entity away."""

import math
import random
import re
from collections import Counter

import pytest
from conftest_llm import MESSY, texts_of

from assaybook.llm import pii
from assaybook.llm.rows import text_key, whole_text

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def by_hand(text):
    return [(k, m.start(), m.end(), m.group()) for k in PATTERNS for m in re.finditer(PATTERNS[k], text) if valid(k, m.group())]


def base_of(row):
    return [tuple(s) for s in row["base"]]


def test_patterns(make):
    random.seed(2)
    letters = "ab1.2@-+ ()%_9é\n5\U0001F600"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 80))) for _ in range(1500)]
    texts += ["a@b.c_d@e.f", "a@b.c.d@e.f@g.h", "1.2.3.4.5.6.7.8", "1" * 3000, "a" * 20000, "a.a@" * 300, "a@b" + ".a" * 20000, "+1" * 3000, "1 " * 5000,
              "4111 1111 1111 1111", "4111-1111-1111-1112", "300.1.1.1 007.08.9.255", "+49 (30) 123-456 78", "x@y", "x@y.z."]
    for r in pii.find_base(make(list(enumerate(texts)))).collect():
        assert base_of(r) == by_hand(texts[r["doc"]]), texts[r["doc"]][:80]


def test_messy_rows(messy):
    rows = pii.find_personal_data(messy).collect()
    assert Counter((r["doc_id"], str(base_of(r))) for r in rows) == Counter((d, str(by_hand(t))) for d, t in texts_of())
    clean = pii.sanitise(messy).collect()
    assert Counter(str(r["row"]) for r in clean) == Counter(map(str, messy.collect()))
    want = {16: "mail [EMAIL] or [PHONE], [IP] and [CARD] please"}
    assert all(r["text"] == want.get(r["doc_id"], r["row"]["text"] or "") for r in clean) and len(clean) == len(MESSY)


def added_of(rows, **settings):
    """(doc_id) to what is added in its text, as {(text, kind)}."""
    return lambda df: {r["doc_id"]: {(dict(rows)[r["doc_id"]][s["start"] : s["end"]], s["kind"]) for s in r["added"]} for r in pii.find_personal_data(df, **settings).collect()}


def test_terms_that_give_an_entity_away(make):
    random.seed(3)
    filler = "river stone paper light cloud room opening at".split()
    rows = [(i, " ".join(random.choice(filler) + f" note{i}" for _ in range(20))) for i in range(60)]
    # Grumbold stands beside one address only, and so does its number; other words stand everywhere, or once
    rows += [(100 + i, f"opening {i} " + "river " * 3 + f"Grumbold at kim@zed.org room 9021 {filler[i % 5]} closing{i}") for i in range(5)]
    rows += [(200 + i, f"river Otterby at max@def.org {'cloud' if i else 'paper'}") for i in range(2)]                # two texts
    found = added_of(rows)(make(rows))
    assert all(found[100 + i] == {("Grumbold", "remove"), ("9021", "remove")} for i in range(5))
    assert found[200] == found[201] == {("Otterby", "generalise")} and not any(found[d] for d in range(60))
    shown = {r["doc_id"]: r["text"] for r in pii.sanitise(make(rows), remove=2.0).collect()}
    assert "Grumbold" not in shown[101] and "[NAME] at [EMAIL] room [NUMBER]" in shown[101]


@pytest.mark.parametrize("n", [20, 100, 1000])
def test_one_text_proves_nothing_whatever_the_size_of_the_corpus(make, n):
    rows = [(0, "write to zed@quill.example please"), *[(1 + i, "write to zed@quill.example please") for i in range(5)]]
    rows += [(100 + i, f"something about {i} else") for i in range(n)]
    assert not any(added_of(rows)(make(rows)).values())


def planted(n, seed):
    """Texts with addresses, each beside its owner's name in four of them, among rare bystanders; the names by document."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("bcdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(5))
    common = [word() for _ in range(200)]
    rows, names, others = [], {}, []
    for e in range(20):
        name = word()
        for k in range(4):
            once, shared = [word() for _ in range(5)], word()
            others.append(shared)
            rows.append((len(rows), " ".join([*rnd.choices(common, k=30), *once, shared, name, f"p{e}@mail{e}.org", *rnd.choices(common, k=20)])))
            names[len(rows) - 1] = name
    while len(rows) < n:
        rows.append((len(rows), " ".join([*rnd.choices(common, k=40), *rnd.sample(others, 2), word()])))
    return rows, names


@pytest.mark.parametrize("n", [200, 2000])
def test_planted_names_among_rare_bystanders(make, n):
    """Precision and recall at two sizes of the corpus."""
    rows, names = planted(n, seed=n)
    found = added_of(rows)(make(rows))
    hits = [(d, w) for d, own in found.items() for w, _ in own]
    right = sum(names.get(d) == w for d, w in hits)
    assert right / len(names) >= 0.95 and right / len(hits) >= 0.95


def brute_terms(rows):
    """The formula over sets of documents in plain Python: {(text, term): share}."""
    texts = [t or "" for _, t in rows]
    entities = {t: {("email", m.lower()) for m in re.findall(r"[a-z0-9]+@[a-z0-9]+\.[a-z]+", t)} for t in set(texts)}
    terms = {t: {w.lower() for w in re.findall(r"[A-Za-z0-9]{3,}", re.sub(r"[a-z0-9]+@[a-z0-9]+\.[a-z]+", "\uffff", t))} for t in set(texts)}
    every = {t: {w.lower() for w in re.findall(r"[A-Za-z0-9]{3,}", t)} for t in set(texts)}
    n, out = len(texts), {}
    for e in set().union(*entities.values()):
        held = [t for t in texts if e in entities[t]]
        for w in set().union(*[terms[t] for t in held]):
            both = [t for t in held if w in terms[t]]
            seen, m = len(both) / sum(w in every[t] for t in texts), len(set(both)) - 1
            if not m or len(held) == n:
                continue
            m, z = m / seen, pii.SURE
            p = (seen + z * z / (2 * m) - z * math.sqrt(seen * (1 - seen) / m + z * z / (4 * m * m))) / (1 + z * z / m)
            if p >= pii.GENERALISE and p >= pii.LIFT * len(held) / n:
                for t in set(both):
                    out[t, w] = max(out.get((t, w), 0), p)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_terms_equal_the_formula_over_sets_of_documents(make, seed):
    rnd = random.Random(seed)
    words = [f"word{i}" for i in range(25)]
    rows = []
    for i in range(120):
        own = rnd.sample(words, rnd.randint(1, 8)) + rnd.sample([f"m{j}@a.org" for j in range(6)], rnd.choice([0, 0, 1, 2]))
        rows.append((i, " ".join(own)))
    rows += [(200 + i, rows[rnd.randrange(120)][1]) for i in range(40)] + [(300, None), (301, "")]
    rows += [(400 + i, f"same everywhere hot@all.org {w}") for i, w in enumerate(words * 4)]          # an entity of a third of all documents
    df = make(rows)
    base = pii.find_base(df)
    told = pii.disclosing_terms(df, base).join(df.select(*[c.alias(k) for c, k in zip(text_key(whole_text()), ("k1", "k2"))], "text").distinct(), ["k1", "k2"])
    got = {(r["text"], r["term"]): r["share"] for r in told.collect()}
    want = brute_terms(rows)
    assert got.keys() == want.keys() and want and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_terms_far_from_the_entity(make):
    random.seed(5)
    filler = lambda n: " ".join(random.choice("river stone paper light cloud and soon members".split()) for _ in range(n))
    rows = [(i, filler(40)) for i in range(200)]
    # a heading, a footer a thousand characters on, and the name once more behind it; lists of many addresses
    rows += [(300 + i, f"Ashgrove {filler(200)} tom@abc.org and soon {filler(60)} ASHGROVE {filler(i)}") for i in range(5)]
    rows += [(400 + k, "Members " + " ".join(f"{filler(1)} m{j}@club.org" for j in range(300)) + " Thistledown") for k in range(2)]
    found = {r["doc_id"]: r for r in pii.find_personal_data(make(rows + rows[200:201])).collect()}
    of = lambda d: [(dict(rows)[d][s["start"] : s["end"]], s["kind"]) for s in found[d]["added"]]
    for i in range(5):
        assert of(300 + i) == [("Ashgrove", "remove"), ("ASHGROVE", "remove")]
    assert of(400) == of(401) == [("Thistledown", "generalise")] and not any(of(d) for d in range(200))


def test_added_spans_come_by_kind_and_start(make):
    rows = [(i, f"Quillby {i} Ottery kim@zed.org Marrow number{i}") for i in range(2)] + [(10 + i, f"Quillby {i}x kim@zed.org Marrow day{i}") for i in range(6)]
    rows += [(100 + i, f"nothing here {i}") for i in range(100)]
    (row,) = pii.find_personal_data(make(rows)).filter("doc_id = 0").collect()
    assert [(s["kind"], rows[0][1][s["start"] : s["end"]]) for s in row["added"]] == [("generalise", "Ottery"), ("remove", "Quillby"), ("remove", "Marrow")]


def test_no_rows(nothing):
    assert pii.find_personal_data(nothing).isEmpty() and pii.sanitise(nothing).isEmpty()


def test_no_python_in_the_plan(messy):
    plan = pii.find_personal_data(messy)._jdf.queryExecution().executedPlan().toString() + pii.find_base(messy)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
