import random

from roadpulse.llm import chat


def plain(rows):
    """By brute force; a row without a number is a conversation of its own."""
    convs = {}
    for i, (c, turn, role, text) in enumerate(rows):
        convs.setdefault((c, i if c is None else None), []).append((turn, role, text))
    key = lambda t: tuple((v is not None, v if v is not None else 0) for v in t)
    convs = {c: [t[1:] for t in sorted(v, key=key)] for c, v in convs.items()}
    out = set()
    for (c, _), turns in convs.items():
        same = [d for (d, _), v in convs.items() if v == turns]
        known = [d for d in same if d is not None]
        if any(len(v) > len(turns) and v[: len(turns)] == turns for v in convs.values()):
            continue
        if c != (min(known) if known else None):
            continue
        text = "".join(f"<|im_start|>{r if r is not None else 'unknown'}\n{t or ''}<|im_end|>\n" for r, t in turns)
        out.add((str(c), len(turns), len(same), text))
    return sorted(out)


def run(llm, rows, block=chat.BLOCK):
    """Rendered conversations, their parts put together."""
    df = llm.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, h1 string")
    whole, seen = {}, set()
    for r in sorted(chat.format_chats(df.repartition(3), block).collect(), key=lambda r: r["part"]):
        # Conversations without a number are told apart by their text: they have one part.
        key = (str(r["conv_id"]), r["n_turns"], r["n_copies"], r["rendered"] if r["conv_id"] is None else "")
        assert (key, r["part"]) not in seen and r["rendered"].count(chat.TURN_OPEN) <= block
        seen.add((key, r["part"]))
        whole[key] = whole.get(key, "") + r["rendered"]
    return sorted((*k[:3], v) for k, v in whole.items())


def test_snapshots(llm):
    rng = random.Random(5)
    rows, cid = [], 0
    for _ in range(40):
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "what", "x" * 50])) for _ in range(rng.randint(1, 6))]
        for _ in range(rng.randint(1, 4)):
            cut = rng.randint(1, len(turns))
            rows += [(cid, k, *turns[k]) for k in range(cut)]
            cid += 1
    rows += [(None, 0, "user", "alone"), (None, 1, "user", "z" * 200000), (None, 7, "user", "alone"), (None, 0, "user", "a")]
    rows += [(900, 0, "user", "a"), (900, 0, "user", "a"), (901, None, "user", "a"), (902, 0, "user", "a")]
    assert run(llm, rows) == plain(rows)


def test_long_conversations_in_parts(llm):
    """One conversation with most rows, its snapshots, and repeated turns, in blocks of 4."""
    said = lambda k: ("user" if k % 2 else "bot", f"t{k % 5}")
    rows = [(c, t, *said(t)) for c, n in ((1, 90), (2, 37), (3, 90), (4, 4), (5, 5)) for t in range(n)]
    rows += [(6, None, "user", "same")] * 11 + [(7, t, "bot", "other") for t in range(8)]
    got = run(llm, rows, block=4)
    assert got == plain(rows) and [r[:3] for r in got] == [("1", 90, 2), ("6", 11, 1), ("7", 8, 1)]


def test_native_plan(llm):
    df = llm.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.format_chats(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_empty(llm):
    assert run(llm, []) == []
