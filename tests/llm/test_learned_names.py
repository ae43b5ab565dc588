"""Trades and given names that no list of the library holds: they are learned from the table."""

import random

from brindle.llm import names

DDL = "id string, name string, variants array<string>, exclusions array<string>"
TRADES = [("kelp farming", "kelp fmg"), ("clock mending", "clk mending"), ("kite sewing", "kite sw"), ("bell casting", "bell cst")]
GIVEN = [("agapito", "pito"), ("brunhilde", "hildchen"), ("cuthbert", "cuddy"), ("dorotej", "dorek")]


def syllables(rng, n):
    return "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(n))


def rows(seed=5, n=400):
    rng = random.Random(seed)
    firms = [(syllables(rng, 3), syllables(rng, 4)) for _ in range(n)]
    out, want, i = [], set(), 0
    for k, (a, b) in enumerate(firms):
        full, short = (GIVEN if k % 2 else TRADES)[k // 2 % 4]
        legal = "" if k % 2 else " Ltd"
        ids = [str(i), str(i + 1), str(i + 2)]
        i += 3
        out.append((ids[0], f"{full} {a} {b}{legal}".title(), [f"{short} {a} {b}".title()], []))
        out.append((ids[1], f"{b} {a} {short}{legal}".title(), [], None))
        want.add((min(ids[:2]), max(ids[:2])))
        other, _ = (GIVEN if k % 2 else TRADES)[(k // 2 + 1) % 4]
        out.append((ids[2], f"{other} {a} {b}{legal}".title(), None, []))
    return out, want


def test_labels_are_learned(spark):
    data, want = rows()
    df = spark.createDataFrame(data, DDL)
    labels = names.learned_labels(df)
    for full, short in TRADES:
        head = labels.trades[full.split()[0]]
        assert len(head) == 1 and all(labels.trades[w] == head for w in (full + " " + short).split())
    for full, short in GIVEN:
        assert labels.given[short] == labels.given[full] and len(labels.given[full]) == 1
    got = {tuple(r) for r in names.found(df).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)
