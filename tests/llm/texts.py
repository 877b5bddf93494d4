"""Invented texts for the tests."""

import random

SYLLABLES = ["th", "an", "er", "ing", "re", "on", "st", "ed", "ou", "wh", "ti", "sh", "ble", "or", "he"]


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    out = []
    for k in range(words):
        word = "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
        out.append(word.capitalize() if k % 9 == 0 else word + ("." if k % 9 == 8 else ""))
    return " ".join(out)


def corpus() -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, personal data, odd texts."""
    base = [prose(k, 40 + 13 * k) for k in range(24)]
    passage = prose(777, 90)
    near = base[20].split(" ")
    near[30] = "changed"
    rows = list(enumerate(base))
    rows += [(30, base[3]), (31, base[3]), (32, " ".join(near)), (33, base[20].upper())]
    rows += [(40, f"{prose(40, 30)}. {passage} {prose(41, 20)}"), (41, f"{prose(42, 10)}. {passage} {prose(43, 50)}")]
    rows += [(50, None), (51, ""), (52, " \n\t "), (53, "one two"), (54, "x"), (55, "ñandú 日本語 😀 l'été 'twas I'll"), (56, "a" * 3000)]
    rows += [(60, "mail a.b@c.de, x@y, ip 10.0.0.255 999.1.1.1 1.2.3.4.5.6.7.8 card 4111 1111 1111 1111 or 4111-1111-1111-1112, call +1 (017) 555-7713. +12 ")]
    rows += [(61, "<|endoftext|> is ordinary"), (62, prose(62, 3000)), (62, prose(62, 3000)), (None, "no id at all"), (None, None)]
    return rows
