"""Conversation repair against an exhaustive search over all edits."""

import hashlib
import random
import re
import zlib

import pytest

from lodestone.llm import conversations

EMPTY = hashlib.sha256(b"").hexdigest()


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if re.sub(r"[\x20\x09-\x0D]+$", "", text)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """All edit sequences with at most two inserts in a place, by depth-first search; the least (cost, audit)."""
    kinds, best = faults(rows), [(10**9, "", [])]

    def fits(initials):
        return re.fullmatch(r"(s?(ua)+)?", initials) is not None

    def go(k, cost, audit, said, initials, put):
        if cost > best[0][0] or not re.fullmatch(r"s?(ua)*u?", initials):
            return
        if k == len(rows) and fits(initials):
            best[0] = min(best[0], (cost, audit, said))
        if put < 3:
            for name in ("user", "assistant"):
                go(k, cost + 3, audit + "I", [*said, name + ":"], initials + name[0], put + 1)
        if k == len(rows):
            return
        role, text = rows[k]
        go(k + 1, cost + 4, audit + "D", said, initials, 0)
        if kinds[k] in ("", "truncated"):
            more = 3 * (kinds[k] == "truncated")
            go(k + 1, cost + more, audit + "K", [*said, f"{role}:{text}"], initials + (role[:1] or "?"), 0)
            for name in ("user", "assistant"):
                go(k + 1, cost + 3 + more, audit + "R", [*said, f"{name}:{text}"], initials + name[0], 0)

    go(0, 0, "", [], "", 0)
    return best[0], kinds


def told(rows, turns):
    (cost, audit, said), kinds = brute(rows)
    known = {t for t in turns if t is not None}
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0, "blank": kinds.count("blank"), "duplicate": kinds.count("duplicate"), "truncated": kinds.count("truncated"),
        "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(said).encode()).hexdigest(),
    }


def made(n, seed):
    draw = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(draw.choice([1, 2, 3, 5, 6])):
            role = draw.choice(["user", "assistant", "system", "tool", "u2", None, "", "assistant", "user"])
            text = draw.choice(["Yes.", "no end", "  ", "", None, "What? \n", "é!", f"row {turn}.", f"row {turn}"])
            out.append((conv if conv else None, draw.choice([turn, turn, turn, turn + 4, None]), role, text, "extra"))
    return out


def expected(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text, turn))
    return {c: told([(r, t) for _, _, r, t, _ in sorted(x)], [y[-1] for y in x]) for c, x in by.items()}


@pytest.mark.parametrize("limit", [4096, 2])
def test_repair(spark, limit):
    rows = made(60, 3)
    rows += rows[5:8]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, symbols string").repartition(5)
    got = {r.conv_id: r.asDict() for r in conversations.repair(d, most_rows=limit, rounds=2, rules=3).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for c in want:
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == want[c], c
    texts = {}
    for r in sorted(conversations.repair(d, turns=True, most_rows=limit).collect(), key=lambda r: (r.conv_id or 0, r.position)):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(texts.get(c, [])).encode()).hexdigest() == want[c]["repaired_sha256"] for c in want)


def test_long_conversation(spark):
    """A conversation of many segments, with ties all along, has the same audit whatever the segments and rules."""
    rows = [(1, k, ("user", "tool", "assistant", "user")[k % 4], f"text {k // 3 if k % 7 == 0 else k}" + "." * (k % 5 > 0)) for k in range(3000)] + [(2, 0, "user", "a.")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one, many = ({r.conv_id: r for r in conversations.repair(d, most_rows=n, rounds=m).collect()} for n, m in ((10000, 0), (37, 6)))
    assert one == many and one[2].audit == "KI" and one[1].gaps == 0
    kinds = faults([(r[2], r[3]) for r in rows[:-1]])
    assert (one[1].duplicate, one[1].truncated) == (kinds.count("duplicate"), kinds.count("truncated")) and kinds.count("duplicate") > 9


def test_damage_and_empty(spark):
    rows = made(40, 9)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, dropped string")
    kept = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept += [(conv, turn, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    want = expected(kept)
    got = {r.conv_id: r.asDict() for r in conversations.repair(conversations.damaged(d), "dropped").collect()}
    assert got.keys() == {r[0] for r in rows}
    nothing = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": EMPTY}
    for c, report in got.items():
        assert {k: v for k, v in report.items() if k != "conv_id"} == want.get(c, nothing)
    assert conversations.repair(d.limit(0)).count() == 0 and conversations.repair(conversations.damaged(d.limit(0)), "dropped").count() == 0
    assert conversations.repair(conversations.damaged(d).where("dropped"), "dropped").where("audit = ''").count() == len({r[0] for r in rows if zlib.crc32(f"{' ' if r[0] is None else r[0]}:{' ' if r[1] is None else r[1]}".encode()) % 20 == 0})


def test_rules_share_their_parts():
    grammar = conversations.Grammar(["ua", chr(0x100) + chr(0x100), "s" + chr(0x101)])
    assert grammar.rewrite("suauaua") == chr(0x102) + chr(0x100) and len(grammar.matrices()) == len(conversations.SYMBOLS) + 3
    draw = random.Random(1)
    for _ in range(300):
        symbols = "".join(draw.choice("suaoSUAOBDuaua") for _ in range(draw.randrange(12)))
        assert conversations.Walker(grammar).cut([symbols]) == conversations.Walker(conversations.Grammar()).cut([symbols])
