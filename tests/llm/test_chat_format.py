import itertools
import random
import re

import pytest

from reflume.llm.chat_format import format_chats

LEGAL = re.compile("s?(ua)+")


def brute_cost(turns):
    """Cheapest repair by trying every choice of every turn."""
    from reflume.llm.chat_format import INSERT, JOIN, JOIN_EMPTY, OTHER, RELABEL

    best = 10**9

    def cost_of(role, new):
        return 0 if role == new else OTHER if role not in "sua" else RELABEL

    def walk(k, done, cost):
        nonlocal best
        if cost >= best:
            return
        if k == len(turns):
            for tail in ("", "a", "ua"):
                if LEGAL.fullmatch(done + tail):
                    best = min(best, cost + INSERT * len(tail))
            return
        role, empty = turns[k]
        if done:
            walk(k + 1, done, cost + (JOIN_EMPTY if empty else JOIN) + cost_of(role, done[-1]))
        for n in (0, 1, 2):
            for put in map("".join, itertools.product("sua", repeat=n)):
                for new in "sua":
                    now = done + put + new
                    if re.fullmatch("s?(ua)*u?", now):
                        walk(k + 1, now, cost + INSERT * n + cost_of(role, new))

    walk(0, "", 0)
    return best


def made(seed):
    rng = random.Random(seed)
    names = {"s": "system", "u": " User", "a": "assistant", "x": "tool", "n": None}
    rows, kinds = [], {}
    for conv in range(60):
        for turn in range(rng.randint(1, 5)):
            role, empty = rng.choice("suaauuaxn"), rng.random() < 0.2
            rows.append((conv, turn, names[role], rng.choice([None, " ", ""]) if empty else f"t{rng.random()}"))
            kinds.setdefault(conv, []).append((role, empty))
    return rows, kinds


@pytest.mark.parametrize("chunk", [1024, 2])
def test_cost_is_least_and_result_legal(spark, chunk):
    rows, kinds = made(3)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "conv_id long, turn long, role string, text string, chunk int, cost string")
    got = format_chats(df.repartition(3), chunk).collect()
    for conv, turns in kinds.items():
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(turns) + 1)) and mine[-1].action == "end"
        assert sum(r.cost for r in mine) == brute_cost(turns)
        text = "".join(r.rendered for r in mine)
        messages = re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", text, re.S)
        assert "".join(f"<|{a}|>\n{b}<|end|>\n" for a, b in messages) == text
        assert LEGAL.fullmatch("".join(a[0] for a, _ in messages))
        for _, _, _, t in (r for r in rows if r[0] == conv):
            assert (t or "") in text


def test_cuts_do_not_show(spark):
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "x"]), f"text {t}") for t in range(300)] + [(None, 1, "user", "a"), (None, None, "user", "b"), (2, 1, "assistant", "same"), (2, 1, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(map(str, format_chats(df.coalesce(1)).collect()))
    assert sorted(map(str, format_chats(df.repartition(4), 7).collect())) == whole
    assert len(whole) == len(rows) + 3


def test_empty(spark):
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
