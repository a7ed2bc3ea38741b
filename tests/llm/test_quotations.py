from folioforge.llm import quotations as op
from folioforge.llm.queries import op9_quotations
from folioforge.session import table

SCHEMA = "conv_id long, turn long, role string, text string, thread string, words int"


def run(spark, rows, span=None, monkeypatch=None):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    return {(r.conv_id, r.turn): r for r in op.conversations(df).collect()}


ROWS = [
    (1, 0, "a", "The first message here\nwith a second line"),
    (1, 1, "b", "An unrelated question"),
    (1, 2, "c", "On Monday, a wrote:\n> The FIRST message, here\n\nI agree with it"),
    (1, 3, "a", "On Tuesday, c wrote:\n> On Monday, a wrote:\n>> The first message here\n> I agree with it\nThanks both"),
    (1, 4, "d", "> An unrelated question\nAnswer"),
    (1, 5, "d", "> never said\nnothing to link"),
    (1, 6, "e", "> > Answer\n> Thanks both\n> I agree with it\nlast"),
    (2, 0, "a", "> The first message here\nother conversation"),
    (2, 1, "b", None),
    (3, 0, "a", "same"),
    (3, 1, "b", "same"),
    (3, 2, "c", "> same\nto the latest"),
    (3, 3, "c", ">\n> \n>>>"),
    (None, 0, "a", "> same"),
    (4, None, "a", "> same\nx"),
]


def test_links_threads_and_texts(spark):
    got = run(spark, ROWS)
    assert len(got) == len(ROWS)
    reply = {k: r.reply_to for k, r in got.items() if r.reply_to is not None}
    assert reply == {(1, 2): 0, (1, 3): 2, (1, 4): 1, (1, 6): 2, (3, 2): 1}
    assert {k: (r.thread, r.depth) for k, r in got.items() if k in reply} == {(1, 2): (0, 1), (1, 3): (0, 2), (1, 4): (1, 1), (1, 6): (0, 2), (3, 2): (1, 1)}
    assert got[1, 3].text == "Thanks both" and got[1, 2].text == "I agree with it" and got[2, 1].text == "" and got[1, 3].quotes == 3
    assert not any(line.lstrip().startswith(">") for r in got.values() for line in r.text.splitlines())


def test_long_chain_over_several_windows(spark, monkeypatch):
    rows = [(7, 0, "u", "start")] + [(7, i, "u", f"> {'start' if i == 1 else f'body {i - 1}'}\nbody {i}") for i in range(1, 70)]
    rows += [(7, 100 + i, "u", "> body 3\nx") for i in range(30)]
    whole = op.quote_links
    monkeypatch.setattr(op, "quote_links", lambda lines: whole(lines, span=4))
    got = run(spark, rows)
    assert all(got[7, i].reply_to == i - 1 and got[7, i].depth == i and got[7, i].thread == 0 for i in range(1, 70))
    assert all(got[7, 100 + i].reply_to == 3 for i in range(30))


def test_levels():
    own, quoted = op.parsed("> a\n>> b\n> > c\n >>>d\ne > f\n\ttext")
    assert quoted == [(1, "a"), (2, "b"), (2, "c"), (3, "d")] and own == "e > f\n\ttext"


def test_empty_and_repeated_rows(spark):
    assert op.conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, 0, "a", "x y", "", 0)] * 3 + [(1, 1, "b", "> x y\nz", "", 0)] * 2, SCHEMA)
    assert sorted((r.turn, r.reply_to) for r in op.conversations(df).collect() if r.turn) == [(1, 0), (1, 0)]


def test_rewrapped_quotes_are_linked(spark):
    long = "A sentence of some length, which the mail client of whoever answers\nwill break at other places, as they do, and then quote it line by line"
    rows = [(1, 0, "a", long), (1, 1, "b", "Something else altogether, of about the same length as the other one is"), (1, 2, "c", "> A sentence of some length, which\n> the mail client of whoever answers will\n> break at other places,\n\nquite")]
    rows += [(1, 3, "d", "> some length, which the mail client of whoever answers will break at\nin part"), (1, 4, "e", "a b c\nd e f"), (1, 5, "f", "> a b c d e f\nwhole"), (1, 6, "g", "p q r s"), (1, 7, "h", "> p q\n> r s\nyes")]
    got = run(spark, rows)
    assert {k: r.reply_to for k, r in got.items()} == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 0, (1, 4): None, (1, 5): 4, (1, 6): None, (1, 7): 6}


def test_texts_without_quotes_stay_as_they_are(spark):
    texts = ["  indented\r\n\r\nlines \n", "On Monday, a wrote:\nnothing quoted", " ", "a > b"]
    got = run(spark, [(1, i, "a", t) for i, t in enumerate(texts)])
    assert [got[1, i].text for i in range(4)] == texts


def brute(rows):
    """reply_to, thread and depth of messages by looking at every earlier message. Quoted passages are whole texts or runs of their words."""
    from itertools import groupby

    def norm(x):
        return tuple(op.normalised_words(x.encode()))

    def marks(w):  # as the docstring has it: of four runs of four words the one with the least hash, or the whole
        if not w:
            return set()
        if len(w) < 7:
            return {w}
        ids = op.WordIds()
        h = [(int(op.shingle_hashes(ids.of(list(w[i : i + 4])), 4)[0]), w[i : i + 4]) for i in range(len(w) - 3)]
        return {min(h[i : i + 4])[1] for i in range(len(h) - 3)}

    own, reply = {}, {}
    for conv, turn, _, text in rows:
        body, quoted = op.parsed(text)
        own[conv, turn] = marks(norm(body)) | {w for x in [*body.split("\n"), *body.split("\n\n")] if 0 < len(w := norm(x)) < 7}
        votes = {}
        seen = set()
        for level, lines in groupby(quoted, key=lambda x: x[0]):
            lines = [norm(x) for _, x in lines]
            for m in marks(sum(lines, ())) | {w for w in lines if 0 < len(w) < 7}:
                seen.add((level, m))
        least = {}
        for level, m in seen:
            least[m] = min(level, least.get(m, 99))
        for m, level in least.items():
            to = max((t for c, t in own if c == conv and t < turn and m in own[c, t]), default=None)
            if to is not None:
                lv, n = votes.get(to, (99, 0))
                votes[to] = (min(lv, level), n + (len(m) if len(m) < 7 and not (len(m) == 4 and len(sum([norm(x) for _, x in quoted], ())) >= 7 and m not in {norm(x) for _, x in quoted}) else 2))
        if votes:
            reply[conv, turn] = min(votes, key=lambda t: (votes[t][0], -votes[t][1], -t))
    out = {}
    for conv, turn, *_ in rows:
        at, depth = turn, 0
        while (conv, at) in reply:
            at, depth = reply[conv, at], depth + 1
        out[conv, turn] = (reply.get((conv, turn)), at, depth)
    return out


def test_against_brute_force(spark):
    import random

    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    rows = []
    for conv in range(12):
        bodies = []
        for turn in range(14):
            body = [[word() for _ in range(rng.choice([1, 3, 5, 9, 20]))] for _ in range(rng.randint(1, 3))]
            text = ""
            if bodies and rng.random() < 0.8:
                src = [w for line in rng.choice(bodies[-5:]) for w in line]
                k = rng.choice([3, 8])
                text = "".join("> " + " ".join(src[i : i + k]) + "\n" for i in range(0, len(src), k))
                if rng.random() < 0.3:
                    text += ">> " + " ".join(w for line in rng.choice(bodies) for w in line) + "\n"
            bodies.append(body)
            rows.append((conv, turn, "r", text + "\n".join(" ".join(line) for line in body)))
    got = run(spark, rows)
    want = brute(rows)
    assert {k: (r.reply_to, r.thread, r.depth) for k, r in got.items()} == want and sum(v[0] is not None for v in want.values()) > 60


def test_query_keeps_every_message(spark, sf):
    rows = table(spark, sf, "conversations").collect()
    got = {(r.conv_id, r.turn): r for r in op9_quotations(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.conv_id, r.turn]
        assert g.text == op.parsed(r.text)[0] and (g.reply_to is None) == (g.depth == 0)
