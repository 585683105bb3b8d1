"""Repaired conversations against a plain search over all edits; ropes, grammar, odd rows."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from rolebook.llm import turn_repair as T
from rolebook.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, edit string, part int"
EMPTY = hashlib.sha256(b"").hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        k = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return out


def search(initials, faults):
    """Least (cost, audit) by best-first search over single edits."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    queue = [(0, "", 0, 0)]
    done = set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if i == len(initials) and state in (0, 3):
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        for x in "ua":
            if (state, x) in step:
                heapq.heappush(queue, (cost + 5, audit + "I", i, step[state, x]))
        if i < len(initials):
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                if (state, initials[i]) in step:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, step[state, initials[i]]))
                for x in "ua":
                    if (state, x) in step:
                        heapq.heappush(queue, (cost + 1 + more, audit + "R", i + 1, step[state, x]))


def plain(rows):
    out = []
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        if not own:
            out.append((conv, 0, 0, 0, 0, 0, 0, "", EMPTY))
            continue
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        faults, seen = [], set()
        for _, _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = search(initials, faults)
        lines, at = [], 0
        for e in audit:
            expect = "assistant" if lines and lines[-1][:1] == "u" else "user"
            if e == "I":
                lines.append(f"{expect}:")
                continue
            role, text = own[at][2:]
            at += 1
            if e != "D":
                lines.append(f"{role if e == 'K' else expect}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def conversations(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "unknown", "", None]
    texts = ["Yes.", "No!", "Why? ", "open end", "", " \n", None, "é.\x0b", "x"]
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 12)):
            if rng.random() < 0.9:
                role = ("user", "assistant")[t % 2] if rng.random() < 0.6 else rng.choice(roles)
                text = f"text {t} of {c}." if rng.random() < 0.5 else rng.choice(texts)
                rows.append((c if c % 11 else None, t + 100 * (c % 11 == 0) * c if rng.random() < 0.97 else None, role, text))
    rows += [(1000, t, ("user", "assistant")[t % 2], f"long {t}" + rng.choice(["", ".", "?"])) for t in range(300)]
    rows += [(1001, t, rng.choice(["user", "system"]), f"{rng.randrange(40)}.") for t in range(200)]
    # one row each (null turns of one conversation would have no order)
    return list({(r[0], r[1]): r for r in rows}.values())


@pytest.mark.parametrize(("seed", "piece", "rules", "partitions"), [(1, 1024, 512, 4), (2, 3, 512, 7), (3, 50, 5, 3), (4, 1, 0, 5)])
def test_like_plain(spark, tmp_path, monkeypatch, seed, piece, rules, partitions):
    monkeypatch.setattr(T, "PIECE", piece)
    monkeypatch.setattr(T, "RULES", rules)
    rows = conversations(seed, 150)
    df = spark.createDataFrame([(*r, "e", 1) for r in rows], SCHEMA)
    df.repartition(partitions).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op12_turn_repair"](spark, str(tmp_path)).collect()
    want = plain(rows)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_repaired_rows_are_legal(spark):
    rows = T.damaged(spark.createDataFrame([(*r, "e", 1) for r in conversations(7, 60)], SCHEMA))
    out = T.repaired(rows, T.plan(rows)).collect()
    read = {}
    for r in sorted(out, key=lambda r: (str(r.conv_id), r.place)):
        read.setdefault(r.conv_id, []).append(r.role[:1])
    assert read and all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in read.values())


def test_repeated_rows_and_no_rows_left(spark):
    gone = next(c for c in range(10_000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in range(1)))
    fine = next(c for c in range(10_000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in range(4)))
    rows = [(gone, 0, "user", "Hi.")] + [(fine, t, r, x) for t, r, x in [(0, "user", "Hi."), (0, "user", "Hi."), (1, "assistant", "Ha."), (3, "assistant", "Ha.")]]
    out = {r.conv_id: r for r in T.report(T.damaged(spark.createDataFrame([(*r, "e", 1) for r in rows], SCHEMA))).collect()}
    assert tuple(out[gone])[1:] == (0, 0, 0, 0, 0, 0, "", EMPTY)
    r = out[fine]
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (1, 0, 2, 0, 2, 4, "KDKD")


def test_empty(spark):
    assert T.report(T.damaged(spark.createDataFrame([], SCHEMA))).collect() == []


def test_rope():
    rng = random.Random(1)
    for _ in range(300):
        texts = ["".join(rng.choice("DIKR" if rng.random() < 0.2 else "K") for _ in range(rng.randint(0, 12))) for _ in range(2)]
        ropes = []
        for t in texts:
            r, at = T.NOTHING, 0
            while at < len(t):
                k = rng.randint(1, 4)
                r, at = r + T.Rope(t[at : at + k]), at + k
            ropes.append(r)
        assert [r.text() for r in ropes] == texts
        assert (ropes[0] < ropes[1]) == (texts[0] < texts[1])


def test_grammar(spark):
    """Rules are the frequent pairs, expand to what they replaced, and change no cost."""
    rng = random.Random(2)
    symbols = [T.symbol("u", False), T.symbol("a", False), T.symbol("u", True), T.MUST_GO]
    seqs = ["".join(rng.choice([symbols[0] + symbols[1]] * 4 + symbols) for _ in range(rng.randint(0, 30))) for _ in range(50)]
    df = spark.createDataFrame([(s, 3) for s in seqs], "symbols string, n long").repartition(3)
    grammar = T.learn(df, 40)
    assert grammar.rules[0][0] == symbols[0] + symbols[1] and len(grammar.rules) > 5
    for s in seqs:
        short = grammar.compressed(s)
        back = short
        for pair, new in reversed(grammar.rules):
            back = back.replace(new, pair)
        assert back == s and len(short) <= len(s)
        a, b = grammar.of(s), T.Grammar([]).of(s)
        text = lambda m: [[c and (c[0], c[1].text()) for c in row] for row in m]
        assert text(a) == text(b)
