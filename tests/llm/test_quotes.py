from pyspark.sql import functions as F

from tidewater.llm import quotes


def test_levels_and_units():
    text = "My view.\n\nOn Monday Ann wrote:\n> I think\n> so.\n>\n> > Why\n>> not?\n> Fine.\nBye"
    reply, own, quoted, passages = quotes.parse(text)
    assert reply == "My view.\n\nBye" and passages == 3
    assert {"my view.", "bye", "my view. bye"} <= own
    assert quoted["i think so."] == 1 and quoted["why not?"] == 2 and quoted["fine."] == 1
    assert quotes.parse(None) == ("", set(), {}, 0) and quotes.parse("> only")[0] == ""
    assert quotes.parse("He wrote:\nplain words")[0] == "He wrote:\nplain words"
    assert quotes.parse("a > b")[0] == "a > b"


ROWS = [
    (1, 0, "user", "How do I sort a list?\nIt is long."),
    (1, 1, "assistant", "Use sorted.\n\nIt copies."),
    (1, 2, "user", "A second question: tuples?"),
    (1, 3, "user", "bob wrote:\n> Use sorted.\n\nThanks"),
    (1, 4, "assistant", "> A second   QUESTION:\n> tuples?\nThey work too."),
    (1, 5, "user", "> > Use sorted.\n> Thanks\nStill unsure"),
    (1, 6, "user", "> words that nobody said\nHm"),
    (2, 0, "user", "> Use sorted.\nOther conversation"),
    (2, 1, None, None),
    (2, 2, "user", ""),
    (2, 2, "user", ""),
    (None, 0, "user", "Use sorted."),
    (2, None, "user", "> Other conversation\nno turn"),
]


def brute(rows):
    """Parent by search through earlier messages, thread by walking up."""
    parsed = [(c, t, *quotes.parse(x)) for c, t, _, x in rows]
    parent = {}
    for c, t, _, _, quoted, _ in parsed:
        found = []
        for u, level in quoted.items():
            said = [t2 for c2, t2, _, own, _, _ in parsed if c2 == c and c is not None and t2 is not None and u in own]
            if said and t is not None and min(said) < t:
                found.append((-level, len(u.split()), min(said)))
        if found:
            parent[(c, t)] = max(found)[2]
    out = []
    for (c, t, role, _), p in zip(rows, parsed):
        top = t
        while (c, top) in parent:
            top = parent[(c, top)]
        out.append((c, top, t, role, parent.get((c, t)), p[5], p[2], f"<|{role or 'unknown'}|>\n{p[2]}"))
    return out


def order(r):
    return tuple((x is not None, x or 0) for x in r[:3])


def test_reply_order_matches_brute_force(spark):
    frame = spark.createDataFrame([(*r, "extra") for r in ROWS], "conv_id long, turn long, role string, text string, reply string")
    got = [tuple(r) for r in quotes.reply_ordered(frame).collect()]
    want = sorted(brute(ROWS), key=order)
    assert [order(r) for r in got] == [order(r) for r in want]
    assert sorted(got, key=str) == sorted(want, key=str)
    by = {(r[0], r[2]): r for r in got}
    assert by[(1, 3)][4] == 1 and by[(1, 4)][4] == 2 and by[(1, 5)][4] == 3 and by[(1, 6)][4] is None and by[(2, 0)][4] is None


def test_long_chains(spark):
    rows = [(1, 0, "u", "word zero")] + [(1, i, "u", f"> word {'zero' if i == 1 else i - 1}\nword {i}") for i in range(1, 40)]
    got = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(r.thread_turn == 0 for r in got) and [r.turn for r in got] == list(range(40))
    assert [r.parent_turn for r in got[1:]] == list(range(39))


def test_edge_rows(spark):
    frame = spark.createDataFrame([(1, 0, "u", "a b " * 100_000)], "conv_id long, turn long, role string, text string")
    assert len(quotes.reply_ordered(frame).first().reply) == 399_999
    assert quotes.reply_ordered(frame.filter(F.lit(False))).count() == 0


def test_sentences_out_of_a_longer_line(spark):
    """One sentence, several of them re-wrapped, and a part that begins within a sentence."""
    one = "The first step is to read. Then you count the words. After that you sort them! Does it copy? It copies once. Nothing else is kept."
    rows = [
        (1, 0, "u", "How do I count? It is a long text. I have many of them."),
        (1, 1, "a", one),
        (1, 2, "u", "A new topic. Does it copy? I wonder."),
        (1, 3, "u", "> It copies once.\nThat is good"),
        (1, 4, "u", "> Then you count the\n> words. After that you sort\n> them! Does it copy?\nHow"),
        (1, 5, "u", "> is to read. Then you count the words. After that\nGo on"),
        (1, 6, "u", "> It is a long text.\nHow long"),
        (1, 7, "u", "> Nobody said this. Nor that one.\nHm"),
        (1, 8, "u", "> > Nothing else is kept.\n> That is good\nYes"),
    ]
    got = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: r.parent_turn for r in got} == {0: None, 1: None, 2: None, 3: 1, 4: 1, 5: 1, 6: 0, 7: None, 8: 3}
    assert {r.turn: r.thread_turn for r in got}[8] == 1


def test_many_sentences_make_few_units():
    n = 20_000
    found = quotes.units([" ".join(f"s{i}." for i in range(n))])
    assert n < len(found) < 16 * n
    part = quotes.units([" ".join(f"s{i}." for i in range(501, 512))])  # eleven sentences: runs of eight lie in both
    assert max(map(quotes.word_count, part & found)) == 8
