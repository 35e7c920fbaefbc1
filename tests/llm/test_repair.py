import hashlib
import random
import re
import zlib
from functools import cache
from itertools import product

import pytest

from newsloom.llm import repair

EMPTY = hashlib.sha256().hexdigest()


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        fate = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        own = out.setdefault(conv, [])
        if fate == 0:
            continue
        role, text = shown[2:]
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def plain(rows):
    """A conversation's result from its rows after damage, by the least suffix from each row and role before it."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))

    @cache
    def best(i, before):
        """(cost, audit, the repaired rows) of rows i and on after a row with that initial."""
        ways = [(0, "", ())] if i == len(rows) and before in ("", "a") else []

        def take(price, letter, role, text, j, limit):
            initial = role[:1]
            if initial == "s" and before != "" or initial == "u" and before not in ("", "s", "a") or initial == "a" and before != "u" or initial not in ("s", "u", "a"):
                return
            if limit:
                cost, audit, rest = after(j, initial)
            else:
                cost, audit, rest = best(j, initial)
            ways.append((cost + price, letter + audit, ((role, text), *rest)))

        @cache
        def after(j, initial):  # no third insert in a row is ever cheapest
            own = []
            if j == len(rows) and initial == "a":
                own.append((0, "", ()))
            if j < len(rows):
                own += step(j, initial)
            if initial == "u":
                own += [(c + 2, "I" + a, (("assistant", ""), *r)) for c, a, r in ([(0, "", ())] if j == len(rows) else step(j, "a"))]
            elif initial == "a":
                own += [(c + 2, "I" + a, (("user", ""), *r)) for c, a, r in (step(j, "u") if j < len(rows) else [])]
            return min(own)

        if i < len(rows):
            ways += step(i, before)
        take(2, "I", "user", "", i, True)
        take(2, "I", "assistant", "", i, True)
        return min(ways)

    def step(i, before):
        """Ways to use row i itself."""
        _, role, text = rows[i]
        ways = []
        cost, audit, rest = best(i + 1, before)
        ways.append((cost + 3, "D" + audit, rest))
        if faults[i] in ("blank", "duplicate"):
            return ways
        more = faults[i] == "truncated"
        for price, letter, new in ((0, "K", role), (2, "R", "user"), (2, "R", "assistant")):
            if new and before + new[:1] in ("s", "u", "su", "ua", "au"):
                cost, audit, rest = best(i + 1, new[:1])
                ways.append((cost + price + more, letter + audit, ((new, text), *rest)))
        return ways

    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for before in ("", "s", "u", "a"):
            best(i, before)
    cost, audit, out = best(0, "")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()


def check(df, **how):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, repair.repairs(df, **how).collect()), key=repr)
    # rows of one turn stand by role and a hash of the text; where these tests have such rows, they are equal or differ in role
    want = [(conv, *plain(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))) for conv, own in damage(rows).items()]
    assert got == sorted(want, key=repr)
    return got


def exhaustive(kinds):
    """The cheapest (cost, audit) over all edits with up to two inserts between rows."""
    best = None
    gap = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    for gaps in product(gap, repeat=len(kinds) + 1):
        for edits in product(["K", "Ru", "Ra", "D"], repeat=len(kinds)):
            cost, audit, roles = 0, "", ""
            for k in range(len(kinds) + 1):
                cost, audit, roles = cost + 2 * len(gaps[k]), audit + "I" * len(gaps[k]), roles + "".join(gaps[k])
                if k == len(kinds):
                    break
                kind, e = kinds[k], edits[k]
                if kind == "d" and e != "D":
                    cost = 10**6
                audit += e[0]
                cost += {"K": 0, "R": 2, "D": 3}[e[0]] + (kind.isupper() and e != "D")
                roles += kind.lower() if e == "K" else e[1:] if e[0] == "R" else ""
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_every_short_conversation():
    for n in (0, 1, 2):
        for kinds in product("suaxSUAXd", repeat=n):
            assert repair.least(repair.parsed("".join(kinds))) == exhaustive(kinds)
    rng = random.Random(1)
    for _ in range(12):
        kinds = rng.choices("suaxUAd", k=3)
        assert repair.least(repair.parsed("".join(kinds))) == exhaustive(kinds)


def test_charts_of_parts_join_to_the_whole():
    rng = random.Random(2)
    for _ in range(60):
        kinds = "".join(rng.choices("suaxSUAXd", k=rng.randint(0, 40)))
        cut = rng.randint(0, len(kinds))
        a, b = ({x: repair.parsed(part, x) for x in repair.STATES} for part in (kinds[:cut], kinds[cut:]))
        assert repair.joined(a, b) == {x: repair.parsed(kinds, x) for x in repair.STATES}


def test_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))


def made(rng, n, convs):
    roles = ["user", "assistant", "system", "tool", "", None, "agent"]
    return [(rng.choice(convs), rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(["One. ", "two", "", " \t", None, "Really?", "end!\n", "x. y"])) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, one text for each turn and role, and columns that clash with results."""
    rng, own = random.Random(3), {}
    for conv, turn, role, text in made(rng, 900, [None, *range(60)]):
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own.setdefault((conv, turn, " " if fate == 4 or role is None else role), (conv, turn, role, text))
    rows = [*own.values(), *list(own.values())[:40]]
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string, rid int")


def test_odd_rows(odd):
    check(odd)


@pytest.mark.parametrize("long", [0, 5, 12])
def test_long_conversations_in_pieces(odd, long, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 3)
    check(odd, long=long)


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"text {rng.randint(0, 400)}{rng.choice(['.', ''])}") for t in range(600)]
    rows += [(c, t, "user", "again and again.") for c in (2, 3) for t in range(300)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        check(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repairs(none).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    for long in (0, 9):
        assert [tuple(r) for r in repair.repairs(one, long=long).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", EMPTY)]


def test_very_long_text(spark):
    rows = [(5, 0, "user", "word " * 200_000 + "?"), (5, 1, "assistant", "word " * 200_000)]
    check(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
