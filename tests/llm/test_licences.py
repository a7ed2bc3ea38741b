from collections import Counter

from helpers import LONG, clashing, docs

from folioforge.llm import licences as op
from folioforge.llm.decontamination import normalised_words
from folioforge.llm.queries import op7_licences
from folioforge.session import table

MIT = op.TEXTS["MIT"]
TEXTS = [None, "", "word", "Some text.\nReleased under the MIT License.\nMore", "x " * 50 + MIT.upper() + " y" * 50, "\n * ".join(MIT.split(" ")), MIT + "\n" + op.TEXTS["GPL-3.0"], LONG + " " + op.TEXTS["ISC"],
         "of the software in the software of the", MIT.replace("Software", "Program"), "é Licensed under CC BY-NC 4.0. é", "This work is licensed under the GNU General Public License, version 3."]


def found(spark, texts):
    out = {}
    for r in op.licences(clashing(docs(spark, texts))).collect():
        out.setdefault(r.doc_id, []).append((r.licence, r.start, r.end, r.dice))
    return {k: sorted(v, key=lambda x: x[1]) for k, v in out.items()}


def bag(text):
    w = normalised_words(text.encode())
    return Counter(zip(w, w[1:], strict=False))


def test_texts(spark):
    got = found(spark, TEXTS)
    assert {k: [x[0] for x in v] for k, v in got.items()} == {3: ["MIT"], 4: ["MIT"], 5: ["MIT"], 6: ["MIT", "GPL-3.0"], 7: ["ISC"], 9: ["MIT"], 10: ["CC-BY-NC-4.0"], 11: ["GPL-3.0"]}
    assert TEXTS[3][got[3][0][1] : got[3][0][2]] == "Released under the MIT License"
    for k, rows in got.items():  # the Dice of the span that is reported, taken anew
        for name, start, end, dice in rows:
            a = bag(TEXTS[k][start:end])
            best = max(2 * (a & b).total() / (a.total() + b.total()) for n, t in op.templates() if n == name for b in [bag(t)])
            assert abs(best - dice) < 1e-9 and dice >= op.THRESHOLD


def every_stretch(words, names):
    """(name, first, last word, Dice) of all stretches of a text that match a template, one by one."""
    out = []
    for name, t in names:
        b = bag(t)
        for i in range(len(words)):
            for j in range(i + 2, min(len(words), i + 1 + int((2 - op.THRESHOLD) * b.total() / op.THRESHOLD)) + 1):
                a = Counter(zip(words[i:j], words[i + 1 : j], strict=False))
                if (dice := 2 * (a & b).total() / (a.total() + b.total())) >= op.THRESHOLD:
                    out.append((name, i, j - 1, dice))
    return out


def test_against_all_stretches():
    """Whatever is reported matches, and every stretch that matches meets one that is reported and is no worse than the best that it meets."""
    text = "foo bar Distributed under the BSD 3-Clause License. baz This program is licensed under the ISC License and so on under the MIT License, the the of the license. Licensed under CC BY-ND 4.0 x released under the Mozilla Public License v2"
    words = normalised_words(text.encode())
    whole = every_stretch(words, op.templates())
    known = op.built(op.THRESHOLD)
    got = [(known.names[t], a, z + 1, dice) for dice, t, a, z in known.matches(op.bigrams(op.WordIds().of(words)))]
    assert {"BSD-3-Clause", "ISC", "CC-BY-ND-4.0"} <= {g[0] for g in got}
    for name, a, z, dice in got:
        assert any(w[0] == name and (w[1], w[2]) == (a, z) and abs(w[3] - dice) < 1e-9 for w in whole)
    for _, a, z, dice in whole:
        meets = [g for g in got if g[1] < z and a < g[2]]
        assert meets and max(g[3] for g in meets) >= dice - 1e-9


def test_starts_are_those_of_a_plain_count():
    import random

    rng = random.Random(3)
    known = op.built(op.THRESHOLD)
    words = [rng.choice(["under", "the", "license", "licensed", "mit", "of", "x"]).encode() for _ in range(400)]
    grams = op.bigrams(op.WordIds().of(words))
    for t in range(0, len(known.bags), 7):
        own = op.np.array([i for i, g in enumerate(grams.tolist()) if g in known.bags[t]], dtype=int)
        want = [s for s, p in enumerate(own.tolist()) if (Counter(grams[[q for q in own.tolist() if p <= q < p + known.most[t]]].tolist()) & known.bags[t]).total() >= known.least[t]]
        assert known.starts(t, own, grams) == want


def test_family_headers_are_told_apart(spark):
    names = ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "Unlicense", "Zlib", "BSL-1.0"]
    got = found(spark, [op.TEXTS[n] for n in names])
    assert [[x[0] for x in got[i]] for i in range(len(names))] == [[n] for n in names]


def test_full_texts_from_a_folder(spark, tmp_path):
    text = " ".join(f"clause{i % 211} w{i}" for i in range(900))
    (tmp_path / "Own-1.0.txt").write_text(text)
    more = op.from_folder(str(tmp_path))
    rows = op.licences(docs(spark, ["a b " + text + " c d", text.replace("w7", "v7")]), more=more).collect()
    assert [(r.doc_id, r.licence) for r in sorted(rows)] == [(0, "Own-1.0"), (1, "Own-1.0")]


def test_texts_of_common_words_are_quick():
    import time

    words = ("the license of the software is under the license and the license of the " * 2500).encode()
    began = time.time()
    op.built(op.THRESHOLD).matches(op.bigrams(op.WordIds().of(normalised_words(words))))
    assert time.time() - began < 20


def test_repeated_many_times_and_empty(spark):
    got = found(spark, ["Released under the MIT License.\n" * 400])
    assert len(got[0]) == 400
    assert op.licences(docs(spark, ["a"]).where("false")).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id for r in op7_licences(spark, d).collect()}
    lines = {r.doc_id for r in table(spark, d, "documents").collect() if any(f"{x}." in r.text for x in ("the MIT License", "CC BY-NC 4.0", "License, version 3", "License, Version 2.0"))}
    assert got == lines and len(got) > 10
