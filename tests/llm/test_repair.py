"""Repair against dynamic programming, all edit scripts of tiny conversations, and a plain version of the whole contract."""

import hashlib
import itertools
import random
import re
import zlib

from loamgraph.llm import repair

PHASE = {"": 0, "s": 1, "u": 2, "a": 3}


def plain_cheapest(initials, faults):
    """Best (cost, audit) of each phase, row by row; insertions by repeated relaxation."""

    def inserted(best):
        for _ in range(4):
            for phase, (c, t) in list(best.items()):
                to = {"": "u", "s": "u", "u": "a", "a": "u"}[phase]
                new = (c + 5, t + "I")
                if to not in best or new < best[to]:
                    best[to] = new
        return best

    now = inserted({"": (0, "")})
    for have, fault in zip(initials, faults, strict=True):
        new = {}

        def offer(phase, c, t, new=new):
            if phase not in new or (c, t) < new[phase]:
                new[phase] = (c, t)

        for phase, (c, t) in now.items():
            offer(phase, c + 2, t + "D")
            if fault in (repair.SOUND, repair.CUT):
                charge = 5 * (fault == repair.CUT)
                want = {"": "u", "s": "u", "u": "a", "a": "u"}[phase]
                if have == want or (have == "s" and phase == ""):
                    offer(have, c + charge, t + "K")
                offer(want, c + charge + 1, t + "R")
        now = inserted(new)
    return min(now[p] for p in ("", "a") if p in now)


def every_script(initials, faults):
    """By trying all audits of up to three insertions."""
    best, n = None, len(initials)
    for length in range(n, n + 4):
        for audit in map("".join, itertools.product("DIKR", repeat=length)):
            if sum(x != "I" for x in audit) != n:
                continue
            i, roles, cost = 0, "", 0
            for x in audit:
                want = "a" if roles.endswith("u") else "u"
                if x == "I":
                    roles, cost = roles + want, cost + 5
                    continue
                fault, have, i = faults[i], initials[i], i + 1
                if x == "D":
                    cost += 2
                    continue
                if fault in (repair.BLANK, repair.DUPLICATE):
                    break
                cost += (5 if fault == repair.CUT else 0) + (x == "R")
                roles += have if x == "K" else want
            else:
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def test_tiny():
    for n in range(4):
        for initials in itertools.product("sua?", repeat=n):
            r = random.Random(repr(initials))
            faults = bytes(r.randrange(4) for _ in range(n))
            want = every_script("".join(initials), faults)
            assert plain_cheapest(initials, faults) == want == repair.cheapest("".join(initials), faults)


def test_random(monkeypatch):
    r = random.Random(7)
    monkeypatch.setattr(repair, "CHAIN", 3)  # many blocks
    for _ in range(1500):
        n = r.randrange(60)
        initials = "".join(r.choice("sua?" if r.random() < 0.4 else "ua") for _ in range(n)) if r.random() < 0.7 else ("ua" * n)[:n]
        faults = bytes(r.choice([0, 0, 0, 1, 2, 3] if r.random() < 0.5 else [0]) for _ in range(n))
        want = plain_cheapest(initials, faults)
        assert repair.cheapest(initials, faults) == repair.cheapest(initials, faults, chained=True) == want, (initials, faults)


def test_long():
    r = random.Random(8)
    n = 20_000
    initials = "".join(r.choice("uuuas") if r.random() < 0.2 else "ua"[i % 2] for i in range(n))
    faults = bytes(r.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
    # the plain version is quadratic: a part of the rows for it
    assert repair.cheapest(initials[:1500], faults[:1500], chained=True) == plain_cheapest(initials[:1500], faults[:1500])
    cost, audit = repair.cheapest(initials, faults)
    assert sum(x != "I" for x in audit) == n
    rows = repair.edits_of(audit, [("u" if c == "u" else c, "x") for c in initials])
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0][0] for x in rows)) and cost > n / 10
    same = repair.cheapest("u" * n, bytes(n))
    assert same[0] == n // 2


def plain_rows(rows):
    """The contract over (conv_id, turn, role, text)."""
    out = []
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in kept:
            solid = re.sub("[\\x20\\x09-\\x0D]", "", text)
            faults.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = [x[0] for x in kept if x[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        cost, audit = plain_cheapest(["?" if x[1][:1] not in ("s", "u", "a") or not x[1] else x[1][0] for x in kept], faults)
        fixed = repair.edits_of(audit, [x[1:] for x in kept])
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in fixed).encode()).hexdigest()
        out.append((conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def test_rows(spark):
    r = random.Random(9)
    rows = []
    for c in [*range(120), None]:
        for t in range(r.randrange(1, 14)):
            turn = None if r.random() < 0.05 else t + 5 * (r.random() < 0.1)
            rows.append((c, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "U"]), r.choice(["Yes.", "No!", "a  \n", "", None, " \t", "why?\r\n ", "cut", "\u00e9\u6f22.", "x.\u00a0"])))
    rows += [rows[3], rows[3], rows[40]] + [(200, 5, "user", "x." * 300_000), (200, 6, "assistant", "y" * 300_000)] + [(300, i, "user", "same.") for i in range(600)]
    df = spark.createDataFrame([(*x, 1, "d") for x in rows], "conv_id long, turn long, role string, text string, kind int, digest string")
    got = sorted(map(tuple, repair.repair(repair.damaged(df)).collect()), key=repr)
    assert got == plain_rows(rows)
    assert repair.repair(repair.damaged(df.limit(0))).count() == 0
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = repair.repair(repair.damaged(spark.createDataFrame([(gone, 0, "user", "x")], "conv_id int, turn int, role string, text string"))).collect()
    assert list(map(tuple, one)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_sql():
    """The SQL gives the same, also for nulls and odd roles."""
    import duckdb

    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", None, ""]), r.choice(["Yes.", "a  \n", "", None, "cut", "\u00e9\u6f22."])) for c in [*range(40), None] for t in [*range(r.randrange(1, 9)), None]]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(repair.OP12_SQL).fetchall(), key=repr) == plain_rows(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, repair.op12_repair_conversations(spark, sf).collect()), key=repr) == plain_rows(rows)
