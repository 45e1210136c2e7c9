"""Conversation repair against plain searches over all edits."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from aforo.llm import repair
from aforo.llm.repair import Audits, Edit, Repair, Turn

COST = {"K": 0, "R": 3, "D": 4, "I": 3}
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_rows(rows):
    """Faults of a conversation's (turn, role, text) rows, by definition."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    out, seen = [], set()
    for t, role, text in rows:
        tidy = text.strip(repair.WHITE)
        again = (role, text) in seen
        seen.add((role, text))
        fault = "blank" if not tidy else "duplicate" if again else "truncated" if tidy[-1] not in ".!?" else ""
        out.append((t, role, text, fault))
    return out


def every_audit(rows):
    """Cheapest audit by listing all of them, with up to two inserts at each place."""
    made = ["", "u", "a", "ua", "au"]
    best = None
    per_row = [[("D", "", 4)] + ([] if f in ("blank", "duplicate") else
                [(e, i, c + 3 * (f == "truncated")) for e, i, c in (("K", role[:1] or "?", 0), ("R", "u", 3), ("R", "a", 3))])
               for _, role, _, f in rows]
    for picks in itertools.product(*per_row):
        for inserts in itertools.product(made, repeat=len(rows) + 1):
            audit, roles, cost = "I" * len(inserts[0]), inserts[0], 0
            for (e, i, c), more in zip(picks, inserts[1:], strict=True):
                audit, roles, cost = audit + e + "I" * len(more), roles + i + more, cost + c
            cost += 3 * sum(map(len, inserts))
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def plain_repair(rows):
    """Cheapest audit and repaired turns, from the end: the least of all whole rests."""

    @functools.cache
    def rest(i, state, made):
        options = []
        if i == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            _, role, text, fault = rows[i]
            more = 3 * (fault == "truncated")
            steps = [("D", None, 4)]
            if fault not in ("blank", "duplicate"):
                steps += [("K", role, more), ("R", "user", 3 + more), ("R", "assistant", 3 + more)]
            for e, as_role, cost in steps:
                after = state if as_role is None else NEXT.get((state, as_role[:1]))
                if after is not None and (got := rest(i + 1, after, 0)):
                    options.append((cost + got[0], e + got[1], (() if as_role is None else ((as_role, text),)) + got[2]))
        if made < 2:
            for as_role in ("user", "assistant"):
                after = NEXT.get((state, as_role[0]))
                if after and (got := rest(i, after, made + 1)):
                    options.append((3 + got[0], "I" + got[1], ((as_role, ""), *got[2])))
        return min(options, key=lambda o: o[:2], default=None)

    return rest(0, "", 0)


def plain_report(rows):
    rows = plain_rows(rows)
    cost, audit, kept = plain_repair(tuple(rows))
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    faults = [sum(r[3] == f for r in rows) for f in ("blank", "duplicate", "truncated")]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def plain_damage(conv_id, turn, role, text):
    role, text = " " if role is None else role, " " if text is None else text
    name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
    kind = zlib.crc32(name.encode()) % 20
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def run_one(rows, **options):
    one, out = Repair(**options), []
    for t, role, text, fault in plain_rows(rows):
        out += one.add(Turn(t, role, text, fault == "blank", fault == "duplicate", fault == "truncated"))
    cost, rest = one.finish()
    return cost, "".join(e.initial for e in out + rest), tuple((e.role, e.text) for e in out + rest if e.role is not None)


ROLES = ["system", "user", "user", "assistant", "assistant", "tool", "", "agent"]
TEXTS = ["A.", "B!", "cut", " ", "", "C? ", "D."]


def some_rows(rng, n):
    return [(rng.choice([None, *range(n)]), rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(n)]


def test_plain_searches_agree():
    rng = random.Random(1)
    for _ in range(25):
        rows = plain_rows(some_rows(rng, rng.randrange(4)))
        assert every_audit(rows) == plain_repair(tuple(rows))[:2]


@pytest.mark.parametrize("modulus", [repair.MODULUS, 3, 1])
@pytest.mark.parametrize("settle", [repair.SETTLE, 1, 3])
def test_audits_are_cheapest_and_least(modulus, settle):
    rng = random.Random(modulus + settle)
    for _ in range(150):
        rows = some_rows(rng, rng.randrange(12))
        assert run_one(rows, modulus=modulus, settle=settle) == plain_repair(tuple(plain_rows(rows)))


def test_order_of_linked_audits_is_that_of_strings():
    rng = random.Random(5)
    audits, words = Audits(modulus=5), [""]
    for _ in range(300):
        parent, letter = rng.randrange(len(words)), rng.choice("DIKR")
        audits.extend(parent, Edit(letter, None, None, None))
        words.append(words[parent] + letter)
    for a, b in itertools.product(rng.sample(range(301), 60), repeat=2):
        assert audits.less(a, b) == (words[a] < words[b])


def test_long_conversations_stay_small():
    rng = random.Random(2)
    one, largest = Repair(), 0
    for i in range(50_000):
        one.add(Turn(i, rng.choice(["user", "assistant"]), "x.", False, False, rng.random() < 0.1))
        largest = max(largest, len(one.audits.up))
    assert largest < 20 * repair.SETTLE


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(7)
    rows = [(c, t, *r[1:]) for c in [None, *range(60)] for t, r in enumerate(some_rows(rng, rng.randrange(1, 10)))]
    rows += [(100, None, None, None), (100, None, "user", None), (100, 3, None, "x"), (101, 1, "user", "same."), (101, 1, "user", "same.")]
    rows += [(102, 5, "user", "word. " * 20_000), (102, 6, "assistant", "y" * 100_000), (103, None, "user", "a."), (103, 1, "user", "a.")]
    full = [(*r, "mine", 1) for r in rows]
    return rows, spark.createDataFrame(full, "conv_id long, turn long, role string, text string, later string, _k int")


def test_query_against_plain_python(talk):
    rows, df = talk
    want = {}
    for conv_id in {r[0] for r in rows}:
        left = [d for r in rows if r[0] == conv_id for d in plain_damage(*r)]
        want[conv_id] = plain_report(left)
    got = {r[0]: tuple(r)[1:] for r in repair.damage_and_repair(df).collect()}
    assert got == want


def test_lost_conversations_have_zeros(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 1, "user", "x.")], "conv_id long, turn long, role string, text string")
    row = repair.damage_and_repair(df).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns_hold_the_texts(talk):
    rows, df = talk
    got = {}
    for r in repair.repaired_turns(repair.turns_of(df)).orderBy("step").collect():
        got.setdefault(r.conv_id, []).append(r)
    for conv_id in {r[0] for r in rows}:
        plain = plain_rows([(t, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows if c == conv_id])
        _, audit, kept = plain_repair(tuple(plain))
        mine = got.get(conv_id, [])
        assert "".join(r.edit for r in mine) == audit
        assert tuple((r.role, r.text) for r in mine if r.role is not None) == kept


def test_empty_table_gives_no_rows(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair.damage_and_repair(df).collect() == []
    assert repair.repaired_turns(repair.turns_of(df)).collect() == []
