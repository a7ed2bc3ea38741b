import random
import re

from helpers import LONG, clashing, docs

from folioforge.llm import paragraphs as op
from folioforge.llm.minhash import word_list
from folioforge.llm.queries import op4_paragraphs
from folioforge.session import table


def prose(rng, n):
    return [f"w{rng.randrange(10**7)}" for _ in range(n)]


def found(df, least=12):
    out = {}
    for r in op.repeated_passages(df, least).collect():
        out.setdefault(r.doc_id, []).append((r.start, r.end, r.keep))
    return {k: sorted(v) for k, v in out.items()}


def test_passages_of_51_words_are_caught_wherever_they_stand(spark):
    rng = random.Random(2)
    texts, shared = [], []
    for i in range(60):
        p = prose(rng, 51)
        shared += [set(p)] * 2
        for _ in range(2):
            a, b = prose(rng, rng.randint(0, 90)), prose(rng, rng.randint(0, 90))
            texts.append(" ".join(a) + ("\n" if i % 2 else "  ") + ("\n" if i % 3 == 0 else " ").join(p) + "  " + " ".join(b))
    clean = [" ".join(prose(rng, 300)) for _ in range(40)] + [None, "", "a b", "Released under the MIT License.", LONG]
    df = clashing(docs(spark, texts + clean, parts=4))
    got = found(df)
    assert set(got) == set(range(len(texts)))
    for i in range(0, len(texts), 2):
        a, b = got[i], got[i + 1]
        assert all(k for _, _, k in a) and not any(k for _, _, k in b)
    for i, spans in got.items():  # near paragraphs may reach a few words beyond the passage
        words = [w for s, e, _ in spans for w in texts[i][s:e].split()]
        assert len(set(words) & shared[i]) >= op.PASSAGE - 1 and len(set(words) - shared[i]) <= 8


def test_anchors_against_plain_minima():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(n)) for n in (0, 5, 15, 16, 60, 300, 51)]
    t = op.Texts([t.encode() for t in texts], op.WordIds())
    at, h = op.pieces(t)
    want = set()
    for i, x in enumerate(texts):
        w = op.WordIds().of(x.encode().split())
        g = [int(v) >> op.PLACE_BITS for v in op.shingle_hashes(w, op.GRAM)] if len(w) >= op.GRAM else []
        places = {min(range(k, k + op.SPAN), key=lambda p: (g[p], p)) for k in range(len(g) - op.SPAN + 1)}
        want |= {(i, p, " ".join(x.split()[p : p + op.PIECE])) for p in places if p + op.PIECE <= len(w)}
    text, _, start, end = t.places(at, op.PIECE)
    assert {(i, int(f), texts[i][s:e]) for i, f, s, e in zip(text.tolist(), t.places(at, 1)[1], start.tolist(), end.tolist(), strict=True)} == want and len(want) > 10
    words = [x for x, _ in sorted(zip(h.tolist(), [texts[i][s:e] for i, s, e in zip(text.tolist(), start.tolist(), end.tolist(), strict=True)], strict=True))]
    assert len(set(words)) == len({w for _, _, w in want})


def test_every_run_of_51_words_holds_a_piece():
    rng = random.Random(7)
    ids = op.WordIds()
    for _ in range(300):
        t = op.Texts([" ".join(prose(rng, op.PASSAGE)).encode()], ids)
        assert len(op.pieces(t)[0])


def test_run_hashes_do_not_depend_on_the_place():
    w = op.WordIds().of([f"w{i % 7}{i % 3}".encode() for i in range(400)])
    h, size = op.run_hashes(w, 20), 20
    runs = [tuple(w[i : i + size].tolist()) for i in range(len(w) - size + 1)]
    assert len(h) == len(runs) and len(set(h.tolist())) == len(set(runs)) == len(set(zip(runs, h.tolist(), strict=True)))
    assert len(op.run_hashes(w, 401)) == 0


def brute(rows, least):
    """doc_id -> (start, end, keep) by all pairs of paragraphs and all windows."""
    units, windows = [], {}  # (doc, first, n, shingles, words)
    words = {}
    for d, text in rows:
        at = [m.span() for m in re.finditer(r"[^ \t\n\r\x0b\x0c]+", text)]
        low = [text[a:b].encode().lower() for a, b in at]
        words[d] = at
        breaks = [re.sub("\r\n|\r", "\n", text[(at[i - 1][1] if i else 0) : at[i][0]]).count("\n") for i in range(len(at))]
        spans = set()
        for gap, most in ((1, least), (2, least), (10**9, 5)):
            cut = [i for i in range(len(at)) if i == 0 or breaks[i] >= gap] + [len(at)]
            spans |= {(a, b) for a, b in zip(cut, cut[1:], strict=False) if b - a >= max(most, 5)}
        for a, b in spans:
            units.append((d, a, b, {tuple(low[i : i + 5]) for i in range(a, b - 4)}, tuple(low[a:b])))
        for i in range(len(at) - 50):
            windows.setdefault(tuple(low[i : i + 51]), []).append((d, i))
    up = list(range(len(units)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(units):
        for j in range(i):
            n = len(a[3] & units[j][3])
            if n and 100 * n >= 80 * (len(a[3]) + len(units[j][3]) - n):
                up[find(i)] = find(j)
    groups = {}
    for i, u in enumerate(units):
        groups.setdefault(find(i), []).append(u)
    marks = {}  # (doc, keep) -> intervals of words
    for g in [*([(u[0], u[1], u[2]) for u in g] for g in groups.values()), *([(d, i, i + 51) for d, i in w] for w in windows.values())]:
        owner = min(x[0] for x in g)
        if any(x[0] != owner for x in g):
            for d, a, b in g:
                marks.setdefault((d, d == owner), []).append((a, b))
    out = {}
    for (d, keep), spans in marks.items():
        runs = []
        for a, b in sorted(spans):
            if runs and a < runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        gone = {i for a, b in marks.get((d, False), []) for i in range(a, b)} if keep else set()
        for a, b in runs:
            left = len(set(range(a, b)) - gone)
            if not keep or left >= op.LEFT or left == b - a:
                out.setdefault(d, []).append((words[d][a][0], words[d][b - 1][1], keep))
    return {d: sorted(x) for d, x in out.items()}


def test_against_brute_force(spark):
    rng = random.Random(21)
    pool = [prose(rng, rng.randint(3, 130)) for _ in range(25)]

    def part():
        p = list(rng.choice(pool))
        if rng.random() < 0.4:
            p[rng.randrange(len(p))] = "chängéd"
        return p[rng.randint(0, 20) :] if rng.random() < 0.3 else p

    texts = [rng.choice(["\n", "\n\n", " "]).join(" ".join(x) for x in [prose(rng, rng.randint(0, 30)), part(), prose(rng, rng.randint(0, 30)), part()]) for _ in range(60)]
    texts += [" ".join(pool[0]), " ".join(pool[1][:7]), " ".join(pool[1][:7]).upper(), "a b c d", "a b c d"]
    for least in (5, op.LEAST):
        want = brute(list(enumerate(texts)), least)
        assert found(docs(spark, texts, parts=5), least) == want and len(want) > 40


def test_query_against_brute_force(spark, sf):
    """All windows, and all pairs of the paragraphs that share a shingle, of a table."""
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect() if r.text and len(r.text) < 4000]
    small = table(spark, sf, "documents").where("length(text) < 4000")
    assert found(small, op.LEAST) == brute(rows, op.LEAST)


def test_short_equal_documents_are_found(spark):
    got = found(docs(spark, ["one two three four five", "One  two three\nfour five", "one two three four", "one two three four"]), op.LEAST)
    assert got == {0: [(0, 23, True)], 1: [(0, 24, False)]}


def test_repeats_inside_a_document_and_repeated_rows_do_not_count(spark):
    rng = random.Random(3)
    p = " ".join(prose(rng, 80))
    assert found(docs(spark, [p + " x y z " + p, " ".join(prose(rng, 90))])) == {}
    assert found(docs(spark, [p, p], ids=[4, 4])) == {}
    assert found(docs(spark, [p, p], ids=[None, 4])) == {}
    assert found(docs(spark, ["th " * 500, "th " * 700])) != {}
    assert found(docs(spark, [p]).where("false")) == {}


def test_large_shared_passage(spark):
    rng = random.Random(4)
    p = " ".join(prose(rng, 70))
    texts = [" ".join(prose(rng, 40)) + " " + p + " " + " ".join(prose(rng, 40)) for _ in range(300)]
    got = found(docs(spark, texts, parts=4))
    assert set(got) == set(range(300)) and all(k for _, _, k in got[0]) and not any(k for i in range(1, 300) for _, _, k in got[i])


def test_query(spark, sf):
    """No document with a repeated run of 51 words is missed, and none without a repeated paragraph or run is named."""
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    where = {}
    for d, t in rows:
        w = word_list(t.encode())
        for i in range(len(w) - 50):
            where.setdefault(tuple(w[i : i + 51]), set()).add(d)
    must = {d for s in where.values() if len(s) > 1 for d in s}
    where = {}
    for d, t in rows:
        w = word_list(t.encode())
        for i in range(len(w) - 4):
            where.setdefault(tuple(w[i : i + 5]), set()).add(d)
    may = {d for s in where.values() if len(s) > 1 for d in s}
    got = {r.doc_id for r in op4_paragraphs(spark, sf).collect()}
    assert must <= got <= may and must


def test_whole_paragraphs_with_changed_words_are_linked(spark):
    """One changed word wherever it stands leaves Jaccard 0.8 or more, in lines and in blocks of wrapped lines."""
    rng = random.Random(9)
    texts = []
    for i, n in enumerate([51, 51, 60, 60, 60, 60, 100, 100, 400, 3000] * 4):
        p = prose(rng, n)
        q = list(p)
        q[n // 2 if i < 20 else rng.randrange(n)] = "changed"
        between = "\n\n" if i % 2 else "\n"
        own = lambda: " ".join(prose(rng, 11))
        wrap = lambda x, k: "\n".join(" ".join(x[j : j + k]) for j in range(0, n, k)) if i % 2 else " ".join(x)
        texts += [own() + between + wrap(p, 10) + between + own(), wrap(q, 9) + between + own()]
    short = " ".join(prose(rng, 13))
    texts += [short + " x\n" + "a b c", "d\n" + short + " x", " ".join(prose(rng, 200))]
    got = found(docs(spark, texts, parts=4))
    assert set(got) == set(range(len(texts) - 1))
    for i in range(0, 80, 2):
        assert any(k and e - s >= len(texts[i]) - 300 for s, e, k in got[i]) and any(not k and e - s >= len(texts[i + 1]) - 200 for s, e, k in got[i + 1])


def test_paragraph_borders():
    raw = "a b\r\nc\n\n d\r\re\n \t\nf g".encode()
    t = op.Texts([raw, b"h\ni"], op.WordIds())
    lines, blocks, texts = op.borders(t.raw, t.starts, t.doc)
    assert lines.tolist() == [0, 2, 3, 4, 5, 7, 8] and blocks.tolist() == [0, 3, 4, 5, 7] and texts.tolist() == [0, 7]


def test_chains_keep_one_copy_of_every_word(spark):
    """Partly overlapping passages: what is removed from a document stays in another."""
    rng = random.Random(10)
    p = prose(rng, 150)
    texts = [" ".join(prose(rng, 40) + w + prose(rng, 40)) for w in (p[:100], p, p[50:], p[20:140])]
    got = found(docs(spark, texts, ids=[1, 2, 3, 4]))
    left = set()
    for i, t in enumerate(texts, 1):
        gone = [(s, e) for s, e, k in got[i] if not k]
        at = 0
        for w in t.split(" "):
            if not any(s <= at < e for s, e in gone):
                left.add(w)
            at += len(w) + 1
    assert set(p) <= left and all(any(not k for _, _, k in got[i]) for i in (2, 3, 4)) and all(k for _, _, k in got[1])


def test_every_occurrence_is_returned(spark):
    rng = random.Random(11)
    p = " ".join(prose(rng, 80))
    line = " ".join(prose(rng, 15))
    texts = [p + "\n" + line + "\n" + "x y", "a " + p + " b\n" + line + "\nc " + p + " d\n" + line]
    got = found(docs(spark, texts))
    assert all(any(not k and s <= m < e for s, e, k in got[1]) for at in (2, texts[1].rindex("c ") + 2) for m in (at + len(p) // 2,))
    first, last = texts[1].index(line), texts[1].rindex(line)
    assert first < last and all(any(not k and s <= a and e >= a + len(line) for s, e, k in got[1]) for a in (first, last))


def test_matches_are_extended_to_their_full_extent(spark):
    rng = random.Random(12)
    texts, shared = [], []
    for _ in range(40):
        p = prose(rng, rng.randint(51, 120))
        shared += [" ".join(p)] * 2
        texts += [" ".join(prose(rng, 30)) + " " + " ".join(p) + " " + " ".join(prose(rng, 30)) for _ in range(2)]
    got = found(docs(spark, texts, parts=4))
    for i, (t, p) in enumerate(zip(texts, shared, strict=True)):
        at = t.index(p)
        assert any(s <= at and e >= at + len(p) and k == (i % 2 == 0) for s, e, k in got[i])
