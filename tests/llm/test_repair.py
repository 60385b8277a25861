"""Operator 11 against exhaustive search, a plain dynamic programme, and a plain reading of the contract."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from skycat.llm import repair

WHOLE = re.compile(r"(s?(ua)+)?")
COLUMNS = "conv_id long, turn long, role string, text string, kind string, gone2 string, fault string, copies string"


def exhaustive(rows):
    """(cost, audit) over all lists of edits with up to two inserts in each gap; rows: (initial, fault)."""
    best = None
    options = []
    for initial, fault in rows:
        stay = 1 if fault == "cut" else 0
        own = [("D", "", 3)]
        if fault in ("sound", "cut"):
            own += [("K", initial, stay), ("R", "u", 2 + stay), ("R", "a", 2 + stay)]
        options.append(own)
    gaps = ["", "u", "a", "ua", "au"]
    for chosen in itertools.product(*options):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            roles, audit, cost = "", "", 0
            for k, (letter, role, c) in enumerate(chosen):
                roles += put[k] + (role if letter != "D" else "")
                if letter == "K" and role not in ("s", "u", "a"):
                    roles += "?"
                audit += "I" * len(put[k]) + letter
                cost += 2 * len(put[k]) + c
            roles, audit, cost = roles + put[-1], audit + "I" * len(put[-1]), cost + 2 * len(put[-1])
            if (best is None or (cost, audit) < best) and WHOLE.fullmatch(roles):
                best = cost, audit
    return best


#: place in (s?(ua)+)?: 0 nothing, 1 s, 2 a u that waits, 3 whole
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def by_costs(rows):
    """(cost, audit, [(letter, role)]) from the least costs to the end, then the first letter that keeps to them."""
    n = len(rows)
    far = 10**9
    cost = [[far] * 4 for _ in range(n + 1)]

    def steps(i, p):
        if i < n:
            initial, fault = rows[i]
            stay = 1 if fault == "cut" else 0
            yield "D", 3, i + 1, p, ""
            if fault in ("sound", "cut"):
                if (p, initial) in MOVES:
                    yield "K", stay, i + 1, MOVES[p, initial], initial
                for x in "ua":
                    if (p, x) in MOVES:
                        yield "R", 2 + stay, i + 1, MOVES[p, x], x
        for x in "ua":
            if (p, x) in MOVES:
                yield "I", 2, i, MOVES[p, x], x

    for i in range(n, -1, -1):
        if i == n:
            cost[i][0] = cost[i][3] = 0
        for _ in range(5):
            for p in range(4):
                for _, c, j, q, _ in steps(i, p):
                    cost[i][p] = min(cost[i][p], c + cost[j][q])
    i = p = 0
    out = []
    while not (i == n and p in (0, 3) and cost[i][p] == 0):
        letter, _, i2, p2, x = min(s for s in steps(i, p) if s[1] + cost[s[2]][s[3]] == cost[i][p])
        out.append((letter, x))
        i, p = i2, p2
    return cost[0][0], "".join(x for x, _ in out), out


def brute(rows):
    """The contract on rows (conv_id, turn, role, text), read plainly."""
    after = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kept = after.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        kept += [(t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted((checked(c, kept) for c, kept in after.items()), key=str)


def checked(c, kept):
    kept = sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in kept:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "cut" if ink[-1] not in ".!?" else "sound")
        seen.add((role, text))
    turns = [t for t, _, _ in kept if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
    cost, audit, edits = by_costs([(r[1][:1], f) for r, f in zip(kept, faults)])
    rows, out = iter(kept), []
    for letter, x in edits:
        _, role, text = next(rows) if letter != "I" else (None, None, "")
        if letter != "D":
            out.append((role if letter == "K" else {"u": "user", "a": "assistant"}[x]) + ":" + text)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (c, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("cut"), illegal, cost, audit, digest)


def result(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


NUMBER = {"sound": repair.SOUND, "blank": repair.BLANK, "duplicate": repair.DUPLICATE, "cut": repair.CUT}


def parsed(rows):
    r = repair.Repair()
    for initial, fault in rows:
        r.row(initial, "", NUMBER[fault])
    return r.best()[:2]


def test_every_short_conversation():
    kinds = [("s", "sound"), ("u", "sound"), ("a", "sound"), ("u", "cut"), ("a", "blank"), ("x", "sound")]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            want = exhaustive(rows)
            assert parsed(rows) == want == by_costs(rows)[:2], rows


@pytest.mark.parametrize("held", [1, 40, 1 << 20])
def test_long_conversations(monkeypatch, held):
    """Digests brought up to date often, seldom and never give the same result."""
    monkeypatch.setattr(repair, "HELD", held)
    rng = random.Random(7)
    for _ in range(60):
        n = rng.choice([5, 30, 300])
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(["Yes.", "No", "Why?", "", "a b c.", " "])) for _ in range(n)]
        want = checked(1, [(i, *r) for i, r in enumerate(rows)])
        now = repair._Conversation(1)
        seen = set()
        for i, (role, text) in enumerate(rows):
            f = repair.BLANK if not text.strip() else repair.DUPLICATE if (role, text) in seen else repair.SOUND if text[-1] in ".?" else repair.CUT
            seen.add((role, text))
            now.row(i, role, text, f)
        assert now.result() == want


def edge_rows():
    rng = random.Random(3)
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes?"), (1, 1, "assistant", "Yes?"), (1, None, "system", "Be good."),
        (2, 0, None, None), (2, 1, "", "No role."), (2, 2, "user", "long " * 50000 + "."),
        (None, 0, "user", "Who?"), (None, 3, "assistant", "Me. \n\t"), (None, None, None, "x"),
        (3, None, "user", "A."), (3, None, "assistant", "B."), (4, 0, "user", " "), (4, 1, "\U0001f600", "Ünï!"),
    ]
    for c in range(5, 60):
        n = rng.randint(1, 9)
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", "User", None]), rng.choice(["One.", "two", "Three!", None, "Four?", " "])) for t in range(n)]
    rows += [(7000, t, "user" if t % 2 else "assistant", f"Turn {t % 40}.") for t in range(3000)]
    return rows


def test_edge_rows(spark):
    rows = edge_rows()
    df = spark.createDataFrame([(*r, "z", "z", "z", "z") for r in rows], COLUMNS).repartition(5)
    assert result(repair.repaired(repair.damaged(df))) == brute(rows)
    assert repair.repaired(repair.damaged(df.limit(0))).count() == 0
    # without the damage
    whole = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    assert result(repair.repaired(whole)) == [(1, 0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest())]


def test_one_shuffle(spark):
    df = spark.createDataFrame(edge_rows()[:20], "conv_id long, turn long, role string, text string")
    plan = repair.repaired(repair.damaged(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_query(spark):
    from skycat.llm import queries as Q

    sf = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert result(Q.QUERIES["op11_lr_repair"](spark, sf)) == brute(rows)
