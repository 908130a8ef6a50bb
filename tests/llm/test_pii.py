import random
import re

import pytest

from hazardframe.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute(t):
    t = t or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in pii.IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in pii.CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in pii.PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_plain_kinds_match_a_brute_force_version():
    rnd = random.Random(3)
    for letters in ("ab1@@..--+_ 0129 ()\né", "0123456789 -", "012.25", "+1 2(3)4.5-", "a@b."):
        for _ in range(4000):
            t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
            assert sorted(pii.detect(t), key=lambda s: (s[1], pii.KINDS.index(s[0]))) == brute(t), t


@pytest.mark.parametrize("text, kind, source", [
    ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
    ("john.doe(at)example.com", "email", "john.doe(at)example.com"),
    ("é john at example dot com.", "email", "john at example dot com"),
    ("jоhn@exаmple.com ok", "email", "jоhn@exаmple.com"),
    ("jo​hn@example.com", "email", "jo​hn@example.com"),
    ("john [at] exаmple [dot] com", "email", "john [at] exаmple [dot] com"),
    ("call plus one two three four five six seven eight nine zero one", "phone", "plus one two three four five six seven eight nine zero one"),
    ("at 192 dot 168 dot 1 dot 1 now", "ip", "192 dot 168 dot 1 dot 1"),
    ("ping one nine two dot one six eight dot one dot one please", "ip", "one nine two dot one six eight dot one dot one"),
    ("call +1 415 five five five 2671 now", "phone", "+1 415 five five five 2671"),
    ("call +44 two zero 79 four six zero nine five eight", "phone", "+44 two zero 79 four six zero nine five eight"),
    ("four one one one  one one one one one one one one one one one one", "card", "four one one one  one one one one one one one one one one one one"),
])
def test_disguises_are_mapped_back_to_the_source(text, kind, source):
    found = [(k, text[a:b]) for k, a, b, base in pii.spans(text) if not base]
    assert (kind, source) in found


@pytest.mark.parametrize("text", ["look at example.com now", "we met at noon dot", "one two three go", "a dot b", "привет мир.", "at [at] at", "one 12 two go", "page one, 2019 - 2020", "dot one dot", "one dot five"])
def test_clean_texts_have_no_spans(text):
    assert pii.spans(text) == []


def test_table(docs):
    texts = [None, "", "a@b.co", "x" * 200000 + " a@b.co", "1" * 50000, "@" * 50000, "a@b.co john [at] example [dot] com \U0001f600 c@d.e"]
    rows = pii.personal_data(docs([(i, t) for i, t in enumerate(texts)] + [(2, "a@b.co")])).collect()
    assert len(rows) == len(texts) + 1 and all(r.quality == "x" for r in rows)
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.pii if s.base] == brute(r.text)
    last = next(r for r in rows if r.doc_id == 6)
    assert [(s.kind, last.text[s.start:s.end], s.base) for s in last.pii] == [
        ("email", "a@b.co", True), ("email", "john [at] example [dot] com", False), ("email", "c@d.e", True)]
    assert pii.personal_data(docs([])).count() == 0


@pytest.mark.parametrize("text", ["a dot b " + "x" * 200_000, "1" * 200_000 + ".2.3 one", "a.b" * 70_000 + " one dot ", "one two " * 30_000, "a dot " * 40_000,
                                  "+1(" * 60_000 + " one", "1.2.3 " * 40_000 + "dot"])
def test_time_follows_the_length_of_a_text(text):
    import time

    start = time.process_time()
    pii.spans(text)
    assert time.process_time() - start < 5
