"""Composed machines against all edit sequences, and whole tables against a plain walk."""

import hashlib
import itertools
import random
import re

import pytest

from tradewind.llm import conversation_repair as cr

GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(turns: list[str], most: int = 3):
    """(cost, labels, roles) by trying every edit of every turn, and every insertion."""
    choices = []
    for t in turns:
        own = [(4, "D", "")]
        if t != "D":
            extra = 3 if t[0] == "t" else 0
            own += [(extra, "K", t[1])] + [(3 + extra, "R", r) for r in "ua"]
        choices.append(own)
    best = None
    gaps = [("",) + tuple("".join(p) for n in (1, 2) for p in itertools.product("ua", repeat=n))] * (len(turns) + 1)
    for edits in itertools.product(*choices):
        for put in itertools.product(*gaps):
            roles, labels, cost = "", "", 0
            for k in range(len(turns) + 1):
                roles, labels, cost = roles + put[k], labels + "I" * len(put[k]), cost + 3 * len(put[k])
                if k < len(turns):
                    roles, labels, cost = roles + edits[k][2], labels + edits[k][1], cost + edits[k][0]
            if GRAMMAR.fullmatch(roles) and (best is None or (cost, labels) < best[:2]):
                best = (cost, labels, roles)
    return best


def solved(turns):
    end = cr.with_insertions({q: {0: (0, "")} if q in cr.ACCEPTING else {} for q in cr.STATES})
    through = cr.matrix(tuple(turns))[cr.START]
    return min((c + end[r][0][0], labels + end[r][0][1]) for r, (c, labels) in through.items())


@pytest.mark.parametrize("turns", [[], *[list(p) for n in (1, 2) for p in itertools.product(["D", ".s", ".u", ".a", ".-", "tu", "ta"], repeat=n)]])
def test_composition_equals_all_edits(turns):
    assert solved(turns) == cheapest(turns)[:2]


@pytest.mark.parametrize("seed", range(12))
def test_composition_equals_all_edits_of_three(seed):
    r = random.Random(seed)
    turns = [r.choice(["D", ".s", "ts", ".u", ".a", ".-", "tu", "ta"]) for _ in range(3)]
    assert solved(turns) == cheapest(turns)[:2]


@pytest.mark.parametrize("seed", range(6))
def test_matrices_multiply_in_any_grouping(seed):
    r = random.Random(seed)
    turns = tuple(r.choice(["D", ".s", ".u", ".a", ".-", "tu", "ta"]) for _ in range(90))
    whole = cr.matrix(turns)
    for cut in (1, 30, 89):
        left, right = cr.matrix(turns[:cut]), cr.matrix(turns[cut:])
        for q in cr.STATES:
            assert whole[q] == cr._least(*(cr._after(c, s, right[m]) for m, (c, s) in left[q].items()))


def plain(rows):
    """One conversation (turn, role, text) in order, by a walk of its own over the whole of it."""
    rows = sorted(rows, key=lambda t: (t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.rstrip(" \t\n\v\f\r")
        faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ".")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    wanted = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", []), "a": (0, "", []), "u": (3, "I", ["assistant:"]), "s": (6, "II", ["user:", "assistant:"])}
    full = {"u": "user", "a": "assistant"}
    for (_, role, text), fault in zip(reversed(rows), reversed(faults)):
        now = {}
        for q in best:
            options = [(best[q][0] + 4, "D" + best[q][1], best[q][2])]
            if fault not in "bd":
                extra = 3 if fault == "t" else 0
                if (q, role[:1]) in step:
                    c, s, out = best[step[q, role[:1]]]
                    options.append((c + extra, "K" + s, [f"{role}:{text}", *out]))
                c, s, out = best[step[q, wanted[q]]]
                options.append((c + extra + 3, "R" + s, [f"{full[wanted[q]]}:{text}", *out]))
            now[q] = min(options, key=lambda o: o[:2])
        for _ in range(3):
            for q in now:
                c, s, out = now[step[q, wanted[q]]]
                now[q] = min(now[q], (c + 3, "I" + s, [f"{full[wanted[q]]}:", *out]), key=lambda o: o[:2])
        best = now
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, labels, lines = best[""]
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, labels, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations():
    r = random.Random(5)
    texts = ["Yes.", "No!", "", "  \t", "half", "Why?\n", "日本.", "a" * 5000 + ".", "x y z"]
    rows = [(c, t, r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), r.choice([*texts, None])) for c in range(30) for t in range(r.randint(0, 6))]
    hot = [(99, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 700}" + "." * (t % 5 > 0)) for t in range(1500)]
    odd = [(None, 1, "user", "Hi."), (None, None, "assistant", "First."), (7, None, "system", "S."), (7, -3, "user", "Q?"), (5, 3, "user", "Q?"), (5, 3, "user", "Q?"), (40, 0, "user", "a" * 2_000_000)]
    return rows + hot + odd


def test_whole_conversations_equal_a_plain_walk(spark):
    rows = conversations()
    wide = [(*row, "x", 3, b"d") for row in rows]
    frame = spark.createDataFrame(wide, "conv_id long, turn long, role string, text string, part string, chunk int, digest binary")
    got = {row["conv_id"]: tuple(row)[1:] for row in cr.audit(frame).collect()}
    expected = {}
    for conv, turn, role, text in rows:
        expected.setdefault(conv, []).append((turn, role if role is not None else " ", text if text is not None else " "))
    assert got == {conv: plain(turns) for conv, turns in expected.items()}
    edits = cr.repair(frame).where("conv_id = 99").orderBy("step").collect()
    labels = "".join(e["edit"] for e in edits)
    body = "\n".join(f"{e['role']}:{e['text']}" for e in edits if e["edit"] != "D")
    assert [e["step"] for e in edits] == list(range(len(edits)))
    assert got[99][-2:] == (labels, hashlib.sha256(body.encode()).hexdigest())


def test_damage_keeps_every_conversation(spark):
    import zlib

    rows = [(c, t, "user", "One. Two!") for c in range(60) for t in range(2)] + [(None, 1, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in cr.audit(cr.damaged(frame)).collect()}
    assert set(got) == {r[0] for r in rows}
    gone = [c for c in range(60) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in range(2))]
    alone = spark.createDataFrame([(1, k, "user", "x") for k in range(300) if zlib.crc32(f"1:{k}".encode()) % 20 == 0][:1], "conv_id long, turn long, role string, text string")
    (empty,) = cr.audit(cr.damaged(alone)).collect()
    assert tuple(empty)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert all(got[c]["audit"] == "" for c in gone)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.audit(cr.damaged(frame)).collect() == []
    assert cr.repair(frame).collect() == []
