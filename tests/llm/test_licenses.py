from __future__ import annotations

import re

from dayrank.llm import licenses
from tests.llm.helpers import documents


def grams(text):
    plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[a-z0-9]+", plain)
    return set(zip(words, words[1:], strict=False))


def brute(text, threshold=licenses.THRESHOLD):
    text = text or ""
    units = [*text.split("\n"), *re.split("\n[ \t]*\n", text), text]
    words = re.findall("[a-z0-9]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    pairs = list(zip(words, words[1:], strict=False))
    out = []
    for name, template in sorted(licenses.TEMPLATES.items()):
        b = grams(template)

        def alike(own, b=b):
            return 2 * len(own & b) / (len(own) + len(b))

        best = max(alike(grams(u)) for u in units)
        if best < threshold and len(set(pairs) & b) >= threshold / (2 - threshold) * len(b) - 1e-9:
            width = len(re.findall("[a-z0-9]+", template.lower())) - 1
            runs = [alike(set(pairs[k : k + width])) for k in range(len(pairs)) if pairs[k] in b]
            best = max([best, *runs])
        if best >= threshold:
            out.append((name, best))
    return [(s, d) for s, d in out if not any(told(s, d, t, e) for t, e in out if t != s)]


def told(s, dice, t, other):
    """Whether a text of template t explains a match with s."""
    a, b = grams(licenses.TEMPLATES[s]), grams(licenses.TEMPLATES[t])
    alike = 2 * len(a & b) / (len(a) + len(b))
    if alike >= licenses.THRESHOLD - 0.03:
        return other > dice and dice <= alike + 0.03
    return len(a & b) >= 0.95 * len(a) and len(b) > len(a) and other - dice > -0.05


def test_odd_texts_against_brute_force(spark):
    mit, gpl = licenses.TEMPLATES["mit"], licenses.TEMPLATES["gpl-3.0"]
    wrapped = "\n".join(mit[k : k + 60] for k in range(0, len(mit), 60))
    texts = [
        None, "", "\n\n", "one", "two words", mit, mit.upper(), f"intro\n\n{wrapped}\n \t\nrest of it", wrapped,
        mit + " and a few more words than the template has", mit[: len(mit) // 2], gpl.replace("GNU General", "GNU Affero General"),
        "Released under the MIT License.\n\nLicensed under CC BY-NC 4.0.\nRelased under MIT", "MIT License", "the same words " * 50_000,
        "Licensed under CC BY 4.0.", "Größe ist\nReleased under the MIT License!!!\r\n", f"{mit}\n{mit}",
    ]
    rows = list(enumerate(texts)) + [(None, mit), (5, mit)]
    found = licenses.scan(documents(spark, rows)).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, tuple((s.template, s.dice) for s in r.licenses)) for r in found)
    assert got == sorted((i is None, i or 0, tuple(brute(t))) for i, t in rows)


def test_threshold_and_own_templates(spark):
    docs = documents(spark, [(1, "a b c d"), (2, "a b c x"), (3, "q")])
    found = licenses.scan(docs, threshold=0.6, templates={"t": "a b c d", "u": "z"}).orderBy("doc_id").collect()
    assert [[(s.template, s.dice) for s in r.licenses] for r in found] == [[("t", 1.0)], [("t", 4 / 6)], []]
    assert licenses.scan(documents(spark, [])).count() == 0


def test_notices_within_longer_units(spark):
    full, bsd = licenses.TEMPLATES["mit-full"].split(), licenses.TEMPLATES["bsd-3-clause"].split()
    code = "\n".join(f"x{k} = call(a{k}, b{k})" for k in range(400))
    comment = "\n".join("# " + " ".join(full[k : k + 10]) for k in range(0, len(full), 10))
    parts = "\n\n".join(" ".join(bsd[k : k + 30]) for k in range(0, len(bsd), 30))
    line = "some words stand before it here and " * 5 + "Released under the MIT License." + " and more of them follow" * 5
    rows = [(1, f"{comment}\n{code}"), (2, f"intro\n\n{parts}\n\n{code}"), (3, line), (4, code)]
    found = {r.doc_id: {s.template: s.dice for s in r.licenses} for r in licenses.scan(documents(spark, rows)).collect()}
    assert found == {1: {"mit-full": 1.0}, 2: {"bsd-3-clause": 1.0}, 3: {"mit-short": 1.0}, 4: {}}
    assert {i: dict(brute(t)) for i, t in rows} == found


def test_each_notice_gives_its_own_licence_only(spark):
    names = sorted(licenses.TEMPLATES)
    around = "Some words of ours stand here.\n{}\nAnd others follow, of no licence at all."
    rows = [(i, licenses.TEMPLATES[n]) for i, n in enumerate(names)]
    rows += [(100 + i, around.format(licenses.TEMPLATES[n])) for i, n in enumerate(names)]
    both = licenses.TEMPLATES["gpl-2.0"] + "\n\n" + licenses.TEMPLATES["gpl-3.0"]
    found = {r.doc_id: [s.template for s in r.licenses] for r in licenses.scan(documents(spark, [*rows, (999, both)])).collect()}
    assert found.pop(999) == ["gpl-2.0", "gpl-3.0"]
    assert found == {i: [names[i % 100]] for i in found}
