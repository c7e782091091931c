import hashlib
import itertools
import random
import re
import zlib

import pytest

from clickloom.llm import repair as r

ROWS = "conv_id long, turn long, role string, text string, cost long, first string"
WHITE = " \t\n\x0b\x0c\r"


def pattern_fits(initials):
    """Whether free places (?) can be filled so that the roles are in order."""
    n = len(initials)
    return any(
        all(have in ("?", want) and not (have == "?" and want == "s") for have, want in zip(initials, wanted))
        for wanted in (["ua" * (n // 2)] if n % 2 == 0 else ["s" + "ua" * (n // 2)] if n > 1 else [])
    )


def exhaustive(rows):
    """The best (cost, audit) by trying all edits, up to two inserted rows in each gap."""
    best = None
    gaps = ["", "I", "II"]
    options = [["D"] if must_go else ["K", "R", "D"] for _, must_go, _ in rows]
    for chosen in itertools.product(*options):
        for added in itertools.product(gaps, repeat=len(rows) + 1):
            audit, cost, initials = added[0], 2 * len(added[0]), "?" * len(added[0])
            for letter, extra, (initial, _, cut) in zip(chosen, added[1:], rows):
                audit += letter + extra
                cost += {"K": cut, "R": 2 + cut, "D": 3}[letter] + 2 * len(extra)
                initials += {"K": initial or "-", "R": "?", "D": ""}[letter] + "?" * len(extra)
            if (best is None or (cost, audit) < best) and pattern_fits(initials):
                best = cost, audit
    return best


def dynamic(rows):
    """The best (cost, audit) by keeping the best of each state, row by row."""
    nexts = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    free = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserts(best):
        for _ in range(3):
            for q, (cost, audit) in list(best.items()):
                best[free[q]] = min(best.get(free[q], (10**9, "")), (cost + 2, audit + "I"))
        return best

    best = inserts({0: (0, "")})
    for initial, must_go, cut in rows:
        after = {}
        for q, (cost, audit) in best.items():
            steps = [(q, 3, "D")]
            if not must_go:
                steps.append((free[q], 2 + cut, "R"))
                if q in nexts.get(initial, {}):
                    steps.append((nexts[initial][q], int(cut), "K"))
            for to, more, letter in steps:
                after[to] = min(after.get(to, (10**9, "")), (cost + more, audit + letter))
        best = inserts(after)
    return min(best[q] for q in (0, 3) if q in best)


def fixed(rows, audit):
    """Messages after the edits, by role and text."""
    out, at = [], 0
    place = lambda: "user" if not out or out[-1][0][:1] != "u" else "assistant"
    for letter in audit:
        if letter == "I":
            out.append((place(), ""))
            continue
        role, text = rows[at]
        at += 1
        if letter != "D":
            out.append((role if letter == "K" else place(), text))
    return out


def brute(rows):
    """Results by conversation, of rows (conv_id, turn, role, text)."""
    said = lambda x: " " if x is None else str(x)
    after = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        own = after.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, own in after.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, steps, faults = set(), [], [0, 0, 0]
        for _, role, text in own:
            solid = text.rstrip(WHITE)
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            steps.append((role[:1], fault in (0, 1), fault == 2))
        turns = {t for t, *_ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [x[1][:1] for x in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = dynamic(steps)
        made = fixed([x[1:] for x in own], audit)
        text = "\n".join(f"{role}:{text}" for role, text in made)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out[conv] = (gaps, *faults, illegal, cost, audit, sha)
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], ROWS)
    out = r.summary(*r.repair(r.damage(df))).collect()
    assert len({x.conv_id for x in out}) == len(out)
    return {x.conv_id: tuple(x)[1:] for x in out}


def drawn(draw, n, conv):
    texts = ["Hi.", "Ok!", "no", "", " \t", "Why?", "well. \n", "…", "end.x"]
    roles = ["user", "assistant", "system", None, "", "tool", "umbra"]
    turns = [None, *range(n + 3)]
    out = []
    for k in range(n):
        role = ("user", "assistant")[k % 2] if draw.random() < 0.7 else draw.choice(roles)
        text = f"{k}." if draw.random() < 0.4 else draw.choice([None, *texts])
        out.append((conv, k if draw.random() < 0.8 else draw.choice(turns), role, text))
    return out


def test_search_against_all_edits():
    draw = random.Random(1)
    for _ in range(250):
        rows = [
            (draw.choice(["s", "u", "a", "", "t"]), draw.random() < 0.2, draw.random() < 0.3)
            for _ in range(draw.randint(0, 4))
        ]
        rows = [(i, m, c and not m) for i, m, c in rows]
        assert r.search([(i, m, c, 1) for i, m, c in rows]) == exhaustive(rows) == dynamic(rows)


def test_long_search():
    draw = random.Random(2)
    rows = [(draw.choice("uas"), draw.random() < 0.1, False) for _ in range(3000)]
    assert r.search([(*x, 1) for x in rows]) == dynamic(rows)


@pytest.mark.parametrize("limit", [1, 3, 2000])
def test_against_brute_force(spark, monkeypatch, settings, limit):
    monkeypatch.setattr(r, "PIECE_ROWS", limit)
    settings(spark__sql__shuffle__partitions=3)
    draw = random.Random(limit)
    rows = [x for c in range(60) for x in drawn(draw, draw.randint(1, 9), c)]
    rows += drawn(draw, 40, None) + drawn(draw, 120, 500)
    rows += [(600, 3, "user", "same.")] * 50 + [(600, k, "assistant", "same.") for k in range(30)]
    rows += rows[:20]  # repeated rows
    assert found(spark, rows) == brute(rows)


def test_pieces_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(r, "PIECE_ROWS", 7)
    monkeypatch.setattr(r, "PIECE_CHARS", 300)
    draw = random.Random(9)
    rows = drawn(draw, 400, 1) + [(1, 1000, "user", "long " * 5000)]
    assert found(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert found(spark, []) == {}
    gone = next(t for t in range(99) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert found(spark, [(7, gone, "user", "a.")]) == {7: (0, 0, 0, 0, 0, 0, "", empty)}
    assert found(spark, [(None, None, None, None)]) == brute([(None, None, None, None)])


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(x.conv_id, x.turn, x.role, x.text) for x in df.collect()]
    assert found(spark, rows) == brute(rows)


def test_repaired_messages(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", "Hi.", 1), (1, 1, "user", "Yes", 1), (1, 2, "user", "Yes", 1)],
        "conv_id long, turn long, role string, text string, times long",
    )
    whole, several = r.repair(df)
    pieces = whole.union(several).orderBy("seq").collect()
    assert "".join(p.audit for p in pieces) == "KRD" and sum(p.cost for p in pieces) == 6
    assert [tuple(m) for p in pieces for m in p.repaired] == [("user", "Hi."), ("assistant", "Yes")]
